"""Ordered operators on sequences of any length. Rows are sorted into ranges over all sequences, each
range is worked on by itself, and what a range needs of those before or behind it is carried over by a
second pass over a few rows for each range. No task holds more than a range, even of one sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions.shared import stored
from capture_tables.operators.joins import both_sides, nearest_of, own_sides, with_dimension


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows, stored, with _range: of a sequence's rows, later ones have the same or a greater one,
    and those of one place in the order the same."""
    ordered = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return stored(ordered.withColumn("_range", F.spark_partition_id()))


def _carried(ranged: DataFrame, by: list[str], **values: tuple[Column, str]) -> DataFrame:
    """The rows with, for each name, an aggregate of the nearest range of their sequence that has one:
    `before` or `behind` their own, or the `sum` of all before."""
    ranges = ranged.groupBy(*by, "_range").agg(*[value.alias(f"_v_{name}") for name, (value, _) in values.items()])
    w = Window.partitionBy(*by).orderBy("_range")
    # a frame up to the last row is gone through anew for each row: the order is turned round instead
    back = Window.partitionBy(*by).orderBy(F.desc("_range"))
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    take = {
        "before": lambda c: F.last(c, ignorenulls=True).over(before),
        "behind": lambda c: F.last(c, ignorenulls=True).over(behind),
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
    }
    found = ranges.select(*by, "_range", *[take[how](f"_v_{name}").alias(name) for name, (_, how) in values.items()])
    return with_dimension(ranged, found, [*by, "_range"])


def join_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, before: float = 0.3) -> DataFrame:
    """As joins.join_nearest; `by` may be empty. Times are not null."""
    ranged = in_ranges(both_sides(left, right, by, time, value), by, ["_t"])
    own = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    both = _carried(ranged, by, _earlier=(F.max(own), "before"), _later=(F.min(own), "behind"))
    back, ahead = own_sides([*by, "_range"])
    seen = both.withColumn("_p", F.coalesce(back, "_earlier")).withColumn("_n", F.coalesce(ahead, "_later")).where("_side = 1")
    return nearest_of(seen, value, before)


def tracked_runs(df: DataFrame, condition: Column, gap: int = 0, by=("seq",)) -> DataFrame:
    """As temporal.tracked_runs; `by` may be empty."""
    by = list(by)
    ranged = in_ranges(df.where(condition).select(*by, "frame"), by, ["frame"])
    w = Window.partitionBy(*by, "_range").orderBy("frame")
    both = _carried(ranged, by, _before=(F.max("frame"), "before"))
    last = F.coalesce(F.lag("frame").over(w), "_before")
    starts = both.withColumn("_new", F.coalesce((F.col("frame") - last > gap + 1).cast("int"), F.lit(1))).drop("_before")
    island = _carried(starts, by, _runs=(F.sum("_new"), "sum")).withColumn("_run", F.col("_runs") + F.sum("_new").over(w))
    runs = island.groupBy(*by, "_run").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("tracked"))
    return runs.withColumn("length", (F.col("hi") - F.col("lo") + 1).cast("long")).drop("_run")


def last_where(df: DataFrame, condition: Column, order: str, by=("seq",), name: str = "source_frame") -> DataFrame:
    """The rows with the place of the last row up to themselves that meets the condition; `by` may be
    empty. Rows of one place see each other."""
    by = list(by)
    hit = F.when(condition, F.col(order))
    ranged = in_ranges(df, by, [order])
    w = Window.partitionBy(*by, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = _carried(ranged, by, _before=(F.max(hit), "before"))
    return both.withColumn(name, F.coalesce(F.max(hit).over(w), "_before")).drop("_before", "_range")
