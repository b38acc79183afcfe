"""Exact nearest neighbours of points, group by group, whatever the spread of the points.

Groups of up to WHOLE points are met whole. Larger ones are sorted along a space-filling curve and cut
into blocks of BLOCK points with their boxes, on both sides. Two boxes tell how far apart their points
are at least and at most, so that bundles of blocks keep those of the other side that may hold a
neighbour. Each block's nearest one then bounds its points' distances, and a point meets the blocks
within its own bound. The curve runs over places that are linear near a group's middle and logarithmic far from it: a far outlier
costs its own block alone, and a block's points are near each other where points lie close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions.shared import stored
from capture_tables.operators.joins import SMALL_ROWS, with_dimension

AXES = ("x", "y", "z")
#: Points of the largest group that is met whole, and of a block.
WHOLE, BLOCK = 2048, 32
#: Bundles of blocks on a side are at least so many blocks, and about so many at most.
BUNDLE, BUNDLES = 64, 20_000
#: Points of a task that compares blocks.
PART = 20_000
_BITS = 21
#: Bounds are widened by what rounding may take from them.
SLACK = 1 + 1e-9


def _spread(value: Column) -> Column:
    """21 bits with two free ones between each and the next."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def _dealt(points: DataFrame, middles: DataFrame, by: list[str], block: int, bundle: int, total: int) -> DataFrame:
    """The points in order of the curve, stored, with _block and _bundle. These also end where the curve
    goes from one cell of about so many of the `total` points to the next, so that none spans a wide jump of it."""
    places = []
    for n in AXES:
        q = F.col(f"_q{n}")
        wide = F.greatest(q[2] - q[0], F.col(f"_w{n}") * 1e-9, F.lit(1e-300))
        at = F.floor((F.asinh((F.col(f"_{n}") - q[1]) / wide) + 16.0) * float(1 << (_BITS - 5)))
        places.append(F.greatest(F.least(at, F.lit((1 << _BITS) - 1)), F.lit(0)).cast("long"))
    code = F.lit(0).cast("long")
    for k, n in enumerate(AXES):
        code = code.bitwiseOR(F.shiftleft(_spread(F.col(f"_c{n}")), k))
    kept = points.columns
    coded = with_dimension(points, middles, by).withColumns({f"_c{n}": c for n, c in zip(AXES, places, strict=True)}).withColumn("_code", code)
    ordered = coded.select(*kept, "_code").repartitionByRange(*by, "_code").sortWithinPartitions(*by, "_code", "_x", "_y", "_z")
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())

    # a group's middle lies within an eighth of each axis: cells are that much smaller
    def part(size: int, name: str) -> Column:
        cells = max(total // size, 1).bit_length()
        cell = F.shiftright("_code", max(3 * _BITS - 9 - cells, 0))
        return F.struct(F.floor(F.col("_at") / size).alias("at"), cell.alias("cell")).alias(name)

    return stored(numbered.select(*kept, part(block, "_block"), part(block * bundle, "_bundle")))


def _boxes(dealt: DataFrame, keys: list[str], side: str) -> DataFrame:
    """One row for each of `keys`, their names with the side's behind: the box and the points in it."""
    box = [f(f"_{n}").alias(f"_{what}{n}_{side}") for n in AXES for what, f in (("lo", F.min), ("hi", F.max))]
    found = dealt.groupBy(*keys).agg(*box, F.count("*").alias(f"_n_{side}"))
    return found.withColumnsRenamed({k: f"{k}_{side}" for k in keys if k.startswith("_")})


def _apart(low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """The squares of the least and the most that points between `low` and `high` of one side are away
    from those of a box of side b."""
    gap = [F.greatest(F.col(f"_lo{n}_b") - h, l - F.col(f"_hi{n}_b"), F.lit(0.0)) for n, l, h in zip(AXES, low, high, strict=True)]
    reach = [F.greatest(F.col(f"_hi{n}_b") - l, h - F.col(f"_lo{n}_b")) for n, l, h in zip(AXES, low, high, strict=True)]
    return tuple(sum((g * g for g in side[1:]), side[0] * side[0]) for side in (gap, reach))


def _boxes_apart() -> tuple[Column, Column]:
    return _apart([F.col(f"_lo{n}_a") for n in AXES], [F.col(f"_hi{n}_a") for n in AXES])


def _bundles_met(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The pairs of bundles that the k nearest points may lie in."""
    least, most = _boxes_apart()
    lists = pairs.groupBy(*by, "_bundle_a").agg(F.collect_list(F.struct(most.alias("most"), F.col("_n_b").alias("n"), least.alias("least"), "_bundle_b")).alias("_l"))
    # the k nearest are no farther than the boxes with k points that are surely near
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    bound = F.aggregate(F.array_sort("_l"), first, lambda acc, p: F.when(acc["n"] >= k, acc).otherwise(F.struct((acc["n"] + p["n"]).alias("n"), p["most"].alias("d"))), lambda acc: acc["d"])
    near = lists.withColumn("_d", bound).select(*by, "_bundle_a", F.explode(F.filter("_l", lambda p: p["least"] <= F.col("_d") * SLACK)).alias("_p"))
    return near.select(*by, "_bundle_a", F.col("_p._bundle_b").alias("_bundle_b"))


def candidate_pairs(a: DataFrame, b: DataFrame, by: list[str], key: str, keep: list[str], k: int = 1) -> DataFrame:
    """by..., key, d2, _keep: rows of `a` (by, key, x, y, z) with rows of `b` in their groups, among them
    the k nearest of each; d2 is the squared distance, _keep the struct of b's columns `keep`. Rows
    with a null coordinate take no part."""
    left = a.select(*by, key, *[F.col(n).cast("double").alias(f"_{n}") for n in AXES]).dropna(subset=["_x", "_y", "_z"])
    right = b.select(*by, F.struct(*keep).alias("_keep"), *[F.col(n).cast("double").alias(f"_{n}") for n in AXES]).dropna(subset=["_x", "_y", "_z"])
    size = right.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (size["most"] or 0) <= WHOLE:
        other = right.withColumnsRenamed({f"_{n}": f"_b{n}" for n in AXES})
        return _measured(left.join(F.broadcast(other) if (size["all"] or 0) <= SMALL_ROWS else other, by), by, key)
    spread = [F.percentile_approx(f"_{n}", [0.25, 0.5, 0.75], 1000).alias(f"_q{n}") for n in AXES] + [(F.max(f"_{n}") - F.min(f"_{n}")).alias(f"_w{n}") for n in AXES]
    middles, block, bundle = right.groupBy(*by).agg(*spread), BLOCK, BUNDLE
    while block < 2 * k:
        block *= 2
    while size["all"] > block * bundle * BUNDLES:
        bundle *= 2
    dealt = {side: _dealt(df, middles, by, block, bundle, size["all"]) for side, df in (("a", left), ("b", right))}
    bundles = {side: _boxes(df, [*by, "_bundle"], side) for side, df in dealt.items()}
    blocks = {side: _boxes(df, [*by, "_bundle", "_block"], side) for side, df in dealt.items()}
    met = _bundles_met(with_dimension(bundles["a"], bundles["b"], by), by, k)
    # each block of a with the bundles of b that its own bundle meets
    met = blocks["a"].join(met, [*by, "_bundle_a"]).drop("_bundle_a", "_n_a")
    met = stored(with_dimension(met, bundles["b"], [*by, "_bundle_b"]))
    two = dealt["b"].drop("_bundle").withColumnsRenamed({"_block": "_block_b", **{f"_{n}": f"_b{n}" for n in AXES}})
    least, _ = _boxes_apart()
    own, their = ([f"_{what}{n}_{side}" for what in ("lo", "hi") for n in AXES] for side in "ab")
    # few small rows that become many pairs are dealt by their number, not by their bytes
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["all"] // PART)
    spread = lambda df, *keys: df.repartition(parts, *by, *keys)

    # of the bundle about a block's centre the block about it: how far the k nearest are at most
    def about(pairs: DataFrame, other: str) -> DataFrame:
        apart = sum((F.pow(F.col(f"_lo{n}_a") + F.col(f"_hi{n}_a") - F.col(f"_lo{n}_b") - F.col(f"_hi{n}_b"), 2) for n in AXES), F.lit(0.0))
        few = [(F.col("_n_b") < n).alias(name) for name, n in (("none", k), ("few", max(k, block // 4)))]
        best = F.min(F.struct(*few, apart.alias("apart"), other)).alias("_h")
        found = pairs.groupBy(*by, "_block_a").agg(best, *[F.first(c).alias(c) for c in own])
        return found.select(*by, "_block_a", *own, F.col(f"_h.{other}").alias(other))

    point = [F.col(f"_{n}") for n in AXES]
    one = dealt["a"].drop("_bundle").withColumnRenamed("_block", "_block_a")
    home = about(about(met, "_bundle_b").join(blocks["b"], [*by, "_bundle_b"]), "_block_b").select(*by, "_block_a", "_block_b")
    home = spread(one.join(home, [*by, "_block_a"]), "_block_b")
    first = _measured(home.join(spread(two, "_block_b"), [*by, "_block_b"]), by, key)
    bound = first.groupBy(*by, key).agg(F.min("d2").alias("_d") if k == 1 else F.try_element_at(F.array_sort(F.collect_list("d2")), F.lit(k)).alias("_d"))
    one = stored(one.join(bound, [*by, key]).withColumn("_d", F.coalesce("_d", F.lit(float("inf"))) * SLACK))

    # then bundles and blocks within a block's bound, and blocks within a point's
    reach = one.groupBy(*by, "_block_a").agg(F.max("_d").alias("_reach"))
    met = met.join(reach, [*by, "_block_a"]).where(least <= F.col("_reach")).drop(*their, "_n_b")
    met = spread(met, "_bundle_b").join(spread(blocks["b"], "_bundle_b"), [*by, "_bundle_b"]).where(least <= F.col("_reach")).select(*by, "_block_a", "_block_b", *their)
    met = spread(one, "_block_a").join(spread(met, "_block_a"), [*by, "_block_a"]).where(_apart(point, point)[0] <= F.col("_d"))
    return _measured(spread(met, "_block_b").join(spread(two, "_block_b"), [*by, "_block_b"]), by, key)


def _measured(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    d2 = sum((F.pow(F.col(f"_{n}") - F.col(f"_b{n}"), 2) for n in AXES[1:]), F.pow(F.col("_x") - F.col("_bx"), 2))
    return pairs.select(*by, key, d2.alias("d2"), "_keep")


def nearest_row(a: DataFrame, b: DataFrame, by: list[str], key: str, keep: list[str]) -> DataFrame:
    """by..., key, best: for each row of `a` the smallest struct (d2, _keep) of the rows of `b` in its
    group; rows whose group `b` lacks are left out."""
    return candidate_pairs(a, b, by, key, keep).groupBy(*by, key).agg(F.min(F.struct("d2", "_keep")).alias("best"))


def nearest(a: DataFrame, b: DataFrame, by: list[str], squared: bool = False) -> DataFrame:
    """by..., pid, distance to the nearest row of `b` in the group."""
    least = nearest_row(a, b.withColumn("_one", F.lit(1)), by, "pid", ["_one"])
    return least.select(*by, "pid", (F.col("best.d2") if squared else F.sqrt("best.d2")).alias("distance"))


def knn_join(a: DataFrame, b: DataFrame, by: list[str], key: str, other: str, k: int = 1, squared: bool = False) -> DataFrame:
    """The k nearest rows of `b` to each row of `a` in its group: by..., key, other (b's `key`), rank,
    distance, ties to the smaller other."""
    found = candidate_pairs(a, b, by, key, [key], k).withColumn(other, F.col(f"_keep.{key}"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, key).orderBy("d2", other))).where(F.col("rank") <= k)
    return ranked.select(*by, key, other, "rank", (F.col("d2") if squared else F.sqrt("d2")).alias("distance"))


def knn_interpolate(queries: DataFrame, points: DataFrame, by: list[str], value: str, k: int = 4, std: float = 0.1) -> DataFrame:
    """`value` at the queries: of the k nearest points the mean with weights exp(-d / 2 std^2)."""
    near = knn_join(queries, points, by, "pid", "other", k)
    joined = near.join(points.select(*by, F.col("pid").alias("other"), value), [*by, "other"])
    weight = F.exp(-F.col("distance") / (2.0 * std * std))
    return joined.groupBy(*by, "pid").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))
