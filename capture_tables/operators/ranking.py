"""Sorting, top-k and k-th value thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_hypotheses(df: DataFrame, score: str, key: str, by=("seq",)) -> DataFrame:
    """rank from 1 within `by`, highest score first, then the smaller key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))


def top_frames(df: DataFrame, score: str, n: int, *keys: str) -> DataFrame:
    """The n rows of highest score, ties to smaller keys: one TakeOrderedAndProject."""
    return df.orderBy(F.desc(score), *keys).limit(n)


def keep_kth(df: DataFrame, score: str, k: int, by=("seq",)) -> DataFrame:
    """Rows whose score is at least the k-th best of the group, or its lowest if it has fewer."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.desc(score)))
    at = F.least(F.lit(k), F.count("*").over(w))
    bound = F.max(F.when(F.col("_place") == F.col("_at"), F.col(score))).over(w)
    return (
        df.withColumn("_place", place)
        .withColumn("_at", at)
        .withColumn("_bound", bound)
        .where(F.col(score) >= F.col("_bound"))
        .drop("_place", "_at", "_bound")
    )


def refine_range(df: DataFrame, value: str, score: str, k: int = 3, low: float = 0.8, high: float = 1.2, by=("seq",)) -> DataFrame:
    """From the k best (lowest score) candidates: lo = low * min, hi = high * max of the value."""
    w = Window.partitionBy(*by).orderBy(score, value)
    best = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return best.groupBy(*by).agg((F.min(value) * low).alias("lo"), (F.max(value) * high).alias("hi"))


def write_sorted(df: DataFrame, path: str, partition: str = "seq", order: str = "frame") -> None:
    """Parquet with each sequence in one task's files, in frame order."""
    df.repartition(partition).sortWithinPartitions(partition, order).write.mode("overwrite").parquet(path)


def probe_frames(counts: DataFrame, k: int, by=("seq",)) -> DataFrame:
    """Evenly spaced probes floor(i (n - 1) / (k - 1)) of n frames, each once; `counts` has n."""
    step = (F.col("n") - 1) / F.lit(float(max(1, k - 1)))
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return counts.where("n > 0").select(*by, i.alias("i"), step.alias("s")).select(*by, F.floor(F.col("i") * F.col("s")).cast("int").alias("frame")).distinct()
