"""Joins of per-frame tables: by key, nearest time, overlap and offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions import linalg as la

#: A dimension of at most so many rows is broadcast; a larger one is shuffled.
SMALL_ROWS = 100_000

#: So many choices of observations of a frame are made in one stretch, at least.
STRETCH = 4096


def with_dimension(df: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a lookup table, broadcast only where a bounded count shows it is small."""
    small = dimension.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(dimension) if small else dimension, on, how)


def assemble_frames(*tables: DataFrame, on=("seq", "frame")) -> DataFrame:
    """Rows that all tables have, by key; value columns must have different names."""
    return reduce(lambda a, b: a.join(b, list(on), "inner"), tables)


def apply_exclusions(df: DataFrame, frames: DataFrame, views: DataFrame, train, on=("seq", "frame"), view=("seq", "cam")) -> DataFrame:
    """Training rows of excluded views go; rows of excluded frames stay with frame_mask 0."""
    view = list(view)
    marked = df.join(views.select(*view).distinct().withColumn("_view", F.lit(True)), view, "left")
    kept = marked.where(~(F.coalesce("_view", F.lit(False)) & train)).drop("_view")
    gone = frames.select(*on).distinct().withColumn("_gone", F.lit(0))
    return kept.join(gone, list(on), "left").withColumn("frame_mask", F.coalesce("_gone", F.lit(1))).drop("_gone")


def join_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, before: float = 0.3) -> DataFrame:
    """Each left row with the right row of nearest time in its group, ties to the earlier:
    near_time and near_<value>, NULL where the left time lies before the first right time by
    more than `before`, or after the last. One union and one sort for each group; the cost is
    linear in the rows."""
    back, ahead = own_sides(by)
    seen = both_sides(left, right, by, time, value).withColumn("_p", back).withColumn("_n", ahead).where("_side = 1")
    return nearest_of(seen, value, before)


def own_sides(by: list[str]) -> tuple[Column, Column]:
    """The last right row up to each row of both_sides, and the first from it on. A frame that ends at the
    last row is gone through anew for each row, so the second looks back in the order turned round."""
    own = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    order = ["_t", "_side", "_v"]
    looking = lambda *o: F.last(own, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    return looking(*order), looking(*map(F.desc, order))


def both_sides(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """by..., _t, _l, _v, _side: rows of both; right rows, of side 0, sort before left rows of one time."""
    a = left.select(*by, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    return a.unionByName(b).withColumn("_side", F.col("_l").isNotNull().cast("int"))


def nearest_of(seen: DataFrame, value: str, before: float) -> DataFrame:
    """The left rows with the nearer of the right rows _p, up to them, and _n, from them on."""
    earlier = F.col("_n").isNull() | (F.col("_p").isNotNull() & (F.col("_t") - F.col("_p._t") <= F.col("_n._t") - F.col("_t")))
    late = F.col("_n").isNull() & (F.col("_t") > F.col("_p._t"))
    early = F.col("_p").isNull() & (F.col("_n._t") - F.col("_t") > before)
    pick = F.when(late | early, F.lit(None)).otherwise(F.when(earlier, F.col("_p")).otherwise(F.col("_n")))
    return seen.withColumn("_pick", pick).select("_l.*", F.col("_pick._t").alias("near_time"), F.col("_pick._v").alias(f"near_{value}"))


def reference_time(grid: DataFrame, times: DataFrame, by: list[str], camera: str, time: str, value: str, before: float = 0.3) -> DataFrame:
    """For each grid row the camera whose own nearest time is closest (then the smaller camera):
    ref_cam, ref_time; and every camera's row nearest to that time."""
    cams = times.select(*by, camera).distinct()
    per_camera = grid.join(cams, by)
    near = join_nearest(per_camera, times, [*by, camera], time, value, before).where("near_time is not null")
    best = near.groupBy(*grid.columns).agg(
        F.min(F.struct(F.abs(F.col("near_time") - F.col(time)).alias("d"), F.col(camera).alias("c"), F.col("near_time").alias("t"))).alias("b")
    )
    chosen = best.select(*[c for c in grid.columns if c != time], F.col(time).alias("grid_time"), F.col("b.c").alias("ref_cam"), F.col("b.t").alias(time))
    everyone = join_nearest(chosen.join(cams, by), times, [*by, camera], time, value, before)
    return everyone.withColumnRenamed(time, "ref_time")


def join_offset(a: DataFrame, b: DataFrame, offset_a, offset_b, on=("seq",), index: str = "frame") -> DataFrame:
    """Rows of two clips trimmed at different frames of one take: a.index + offset_a equals
    b.index + offset_b. b's value columns must have their own names."""
    left = a.withColumn("_k", F.col(index) + offset_a)
    right = b.withColumn("_k", F.col(index) + offset_b).withColumnRenamed(index, f"other_{index}")
    return left.join(right, [*on, "_k"]).drop("_k")


def restrict_view(df: DataFrame, views: DataFrame, default: int, on=("seq",)) -> DataFrame:
    """Rows of each sequence's selected camera, or of the default one where none is selected."""
    chosen = views.select(*on, F.col("cam").alias("_view"))
    return df.join(chosen, list(on), "left").where(F.col("cam") == F.coalesce("_view", F.lit(default))).drop("_view")


def expand_symmetries(pose: DataFrame, symmetries: DataFrame) -> DataFrame:
    """A row for each symmetry of the pose's object, with the rotation R S in r00..r22."""
    joined = with_dimension(pose, symmetries, ["object"])
    product = la.times(la.matrix("r"), la.matrix("s"))
    keep = [c for c in pose.columns if not (len(c) == 3 and c[0] == "r" and c[1:].isdigit())]
    return joined.select(*keep, "sym_id", *la.named(product))


def mask_overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on..., area_a, area_b, inter, iou of two run-encoded masks (v, u0, u1 half-open)."""
    keys = [*on, "v"]
    right = b.select(*keys, F.col("u0").alias("w0"), F.col("u1").alias("w1"))
    both = F.greatest(F.least("u1", "w1") - F.greatest("u0", "w0"), F.lit(0))
    shared = a.join(right, keys).where("u0 < w1 and w0 < u1").groupBy(*on).agg(F.sum(both).cast("long").alias("inter"))
    area = F.sum(F.col("u1") - F.col("u0")).cast("long")
    sizes = a.groupBy(*on).agg(area.alias("area_a")).join(b.groupBy(*on).agg(area.alias("area_b")), on, "full")
    out = sizes.join(shared, on, "left").select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("area_a", "area_b", "inter")])
    return out.withColumn("iou", F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")))


def observation_choices(observations: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """by..., combo, cams, later: every choice of one observation for each camera of a frame, one row each, combo from
    0 in the order of the lists. `cams` are the frame's cameras (cam) with their observations (o: obs, payload...) in
    order of `obs`; `chosen` reads from them what a choice takes. A frame's choices are dealt over tasks in
    stretches, and neither a list of stretches nor a stretch is longer than STRETCH or the root of their number."""
    seen = observations.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cam", "obs", *payload))).alias("_all"))
    own = lambda cam: F.struct(cam.alias("cam"), F.filter("_all", lambda x: x["cam"].eqNullSafe(cam)).alias("o"))
    frame = seen.withColumn("cams", F.transform(F.array_distinct("_all.cam"), own)).drop("_all")
    later = F.expr("transform(cams, (c, i) -> aggregate(slice(cams, i + 2, size(cams)), 1L, (acc, d) -> acc * size(d.o)))")
    sized = frame.withColumn("later", later).withColumn("_n", F.col("later")[0] * F.size(F.col("cams")[0]["o"]))
    begun = sized.withColumn("_step", F.greatest(F.lit(STRETCH), F.ceil(F.sqrt("_n")))).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("_step")))
    )
    until = F.least(F.col("_from") + F.col("_step"), F.col("_n")) - 1
    dealt = begun.repartition(*by, "_from")
    return dealt.select(*by, F.explode(F.sequence(F.col("_from"), until)).alias("combo"), "cams", "later")


def chosen(camera: Column, later: Column) -> Column:
    """The observation that a row of `observation_choices` takes of one of `cams`, given its entry of `later`."""
    return camera["o"][F.call_function("div", F.col("combo"), later).cast("long") % F.size(camera["o"])]


def observation_combos(observations: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """Every choice of one observation for each camera of a frame, combo from 0 in the order of
    the lists. One row for each (combo, camera) with the chosen payload; `obs` orders the observations."""
    choices = observation_choices(observations, by, payload)
    spread = choices.select(*by, "combo", F.posexplode("cams").alias("_i", "_c"), "later")
    taken = chosen(F.col("_c"), F.col("later")[F.col("_i")])
    return spread.withColumn("_o", taken).select(*by, "combo", F.col("_c.cam").alias("cam"), *[F.col(f"_o.{n}") for n in ("obs", *payload)])


def match_offsets(probes: DataFrame, source: DataFrame, offsets: DataFrame) -> DataFrame:
    """offset, score: mean absolute difference of the probes' cells (pos, cells) from those of
    the source (idx, cells) at offset + pos; offsets that miss a probe are left out."""
    n = probes.count()
    wanted = offsets.crossJoin(F.broadcast(probes) if n <= SMALL_ROWS else probes)
    keyed = wanted.select("offset", "pos", F.col("cells").alias("_p"), (F.col("offset") + F.col("pos")).alias("idx"))
    distance = F.aggregate(
        F.zip_with("_p", "cells", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size("_p")
    )
    scored = keyed.join(source, "idx").select("offset", distance.alias("d"))
    return scored.groupBy("offset").agg(F.avg("d").alias("score"), F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def compare_tracks(spine: DataFrame, on: list[str], value: str, **stages: DataFrame) -> DataFrame:
    """The spine's rows with each stage's value in a column of its name, NULL where it lacks one."""
    for name, df in stages.items():
        spine = spine.join(df.select(*on, F.col(value).alias(name)), on, "left")
    return spine


def pairwise_distances(points: DataFrame, by: list[str], name: str) -> DataFrame:
    """by..., a, b, distance for every pair of different named points with a < b."""
    axes = ("x", "y", "z")
    left = points.select(*by, F.col(name).alias("a"), *axes)
    right = points.select(*by, F.col(name).alias("b"), *[F.col(n).alias(f"_{n}") for n in axes])
    d = la.norm([F.col(n) - F.col(f"_{n}") for n in axes])
    return left.join(right, by).where("a < b").select(*by, "a", "b", d.alias("distance"))


def align_lengths(truth: DataFrame, prediction: DataFrame, by: list[str], order: str, value: str, most_pad: int = 5) -> DataFrame:
    """Each truth row with the prediction row of the same number in its group; a prediction that
    is up to `most_pad` - 1 rows short repeats its last value, a longer gap is an error."""
    w = Window.partitionBy(*by).orderBy(order)
    t = truth.withColumn("_k", F.row_number().over(w))
    p = prediction.select(*by, F.row_number().over(w).alias("_k"), F.col(value).alias(f"pr_{value}"))
    n = p.groupBy(*by).agg(F.max("_k").alias("_n"))
    joined = t.join(p, [*by, "_k"], "left").join(n, by, "left")
    last = F.last(f"pr_{value}", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    short = F.max("_k").over(Window.partitionBy(*by)) - F.coalesce("_n", F.lit(0)) >= most_pad
    checked = F.when(short, F.raise_error(F.lit("the prediction is too short"))).otherwise(last)
    return joined.withColumn(f"pr_{value}", checked).drop("_k", "_n")


def regress_landmarks(vertices: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """on..., landmark, x, y, z: weighted sums of vertices; `weights` is (landmark, vertex, w)."""
    joined = with_dimension(vertices, weights, ["vertex"])
    return joined.groupBy(*on, "landmark").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in ("x", "y", "z")])
