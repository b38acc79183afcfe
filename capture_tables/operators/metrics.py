"""Error metrics of predictions against truth, and their roll-ups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions import linalg as la
from capture_tables.operators.grouped import over_groups, schema_of
from capture_tables.operators.joins import expand_symmetries, with_dimension
from capture_tables.operators.neighbours import WHOLE, nearest

FRAME = ("seq", "frame")
AXES = ("x", "y", "z")


def renamed(df: DataFrame, names, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def pose_error(pr: DataFrame, gt: DataFrame, symmetries: DataFrame, on=FRAME) -> DataFrame:
    """rot_error (radians) and trans_error of each frame, each the smallest over the symmetries
    of the truth's object, independently of the other."""
    r = [f"r{i}{j}" for i in range(3) for j in range(3)]
    t = ["tx", "ty", "tz"]
    truth = expand_symmetries(gt.select(*on, "object", *r, *t), symmetries)
    joined = renamed(pr.select(*on, *r, *t), [*r, *t], "p").join(truth, list(on))
    rotation = la.angle_between(la.matrix("pr"), la.matrix("r"))
    shift = la.norm(la.minus(la.columns("ptx", "pty", "ptz"), la.columns(*t)))
    return joined.groupBy(*on, "object").agg(F.min(rotation).alias("rot_error"), F.min(shift).alias("trans_error"))


def _matched(pr: DataFrame, gt: DataFrame, on, key: str) -> DataFrame:
    return renamed(pr.select(*on, key, *AXES), AXES, "p").join(gt.select(*on, key, *AXES), [*on, key])


def mpjpe(pr: DataFrame, gt: DataFrame, joints: int, root: int, on=FRAME) -> DataFrame:
    """Mean joint distance with the root joint taken off both sides; of joints root to
    root + joints - 1. Frames without the root on either side are NULL."""
    kept = _matched(pr, gt, on, "joint").where(F.col("joint").between(root, root + joints - 1))
    w = Window.partitionBy(*on)
    at_root = lambda c: F.max(F.when(F.col("joint") == root, F.col(c))).over(w)
    parts = [(F.col(f"p{a}") - at_root(f"p{a}")) - (F.col(a) - at_root(a)) for a in AXES]
    return kept.withColumn("_d", la.norm(parts)).groupBy(*on).agg(F.avg("_d").alias("mpjpe"))


def v2v(pr: DataFrame, gt: DataFrame, key: str, on=FRAME) -> DataFrame:
    """Mean distance of matched vertices."""
    d = la.norm([F.col(f"p{a}") - F.col(a) for a in AXES])
    return _matched(pr, gt, on, key).groupBy(*on).agg(F.avg(d).alias("v2v"))


def mpjae(pr: DataFrame, gt: DataFrame, on=FRAME, joint: str = "joint") -> DataFrame:
    """Mean geodesic angle over a frame's joints, in radians; rows hold r00..r22."""
    r = [f"r{i}{j}" for i in range(3) for j in range(3)]
    both = renamed(pr.select(*on, joint, *r), r, "p").join(gt.select(*on, joint, *r), [*on, joint])
    return both.groupBy(*on).agg(F.avg(la.angle_between(la.matrix("pr"), la.matrix("r"))).alias("mpjae"))


def root_error(pr: DataFrame, gt: DataFrame, on=FRAME) -> DataFrame:
    t = ["tx", "ty", "tz"]
    both = renamed(pr.select(*on, *t), t, "p").join(gt.select(*on, *t), list(on))
    return both.select(*on, la.norm([F.col(f"p{c}") - F.col(c) for c in t]).alias("root_error"))


def acceleration_error(df: DataFrame, pr: list[str], gt: list[str], by=("seq",)) -> DataFrame:
    """acc_error: length of the difference of the second differences around each frame; the first
    and the last frame repeat their neighbour's."""
    w = Window.partitionBy(*by).orderBy("frame")
    second = lambda c: F.lag(c).over(w) - 2.0 * F.col(c) + F.lead(c).over(w)
    out = df.withColumn("_e", la.norm([second(p) - second(g) for p, g in zip(pr, gt, strict=True)]))
    filled = F.coalesce("_e", F.lead("_e").over(w), F.lag("_e").over(w))
    return out.withColumn("acc_error", filled).drop("_e")


def jitter(df: DataFrame, names: list[str], by=("seq",)) -> DataFrame:
    """jitter: length of the third difference over rows -2 to +1; the first two rows and the last
    repeat the nearest value."""
    w = Window.partitionBy(*by).orderBy("frame")
    third = lambda c: F.lead(c).over(w) - 3.0 * F.col(c) + 3.0 * F.lag(c).over(w) - F.lag(c, 2).over(w)
    out = df.withColumn("_j", la.norm([third(c) for c in names]))
    filled = F.coalesce("_j", F.lead("_j").over(w), F.lead("_j", 2).over(w), F.lag("_j").over(w))
    return out.withColumn("jitter", filled).drop("_j")


def chamfer(gt: DataFrame, pr: DataFrame, by: list[str], direction: str = "bi") -> DataFrame:
    """Mean distance from each side's points to the nearest of the other: gt_to_pr, pr_to_gt and
    their sum, chamfer."""
    there, back = nearest(gt, pr, by), nearest(pr, gt, by)
    one = there.groupBy(*by).agg(F.avg("distance").alias("gt_to_pr"))
    two = back.groupBy(*by).agg(F.avg("distance").alias("pr_to_gt"))
    if direction == "x_to_y":
        return one
    if direction == "y_to_x":
        return two
    return one.join(two, by).withColumn("chamfer", F.col("gt_to_pr") + F.col("pr_to_gt"))


def fscore(gt: DataFrame, pr: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """share_gt and share_pr: points of a side within the threshold of the other; fscore, 0 where
    both are 0."""
    there, back = nearest(gt, pr, by), nearest(pr, gt, by)
    share = F.avg(F.when(F.col("distance") < threshold, 1.0).otherwise(0.0))
    both = there.groupBy(*by).agg(share.alias("share_gt")).join(back.groupBy(*by).agg(share.alias("share_pr")), by)
    f = F.try_divide(2.0 * F.col("share_gt") * F.col("share_pr"), F.col("share_gt") + F.col("share_pr"))
    return both.withColumn("fscore", F.coalesce(f, F.lit(0.0)))


def normalise_clouds(gt: DataFrame, pr: DataFrame, by: list[str], on: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides less the truth's centroid, over twice its largest radius."""
    if not on:
        return gt, pr
    centre = gt.groupBy(*by).agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    radius = gt.join(centre, by).groupBy(*by, *[f"_c{a}" for a in AXES]).agg(
        (2.0 * F.max(la.norm([F.col(a) - F.col(f"_c{a}") for a in AXES]))).alias("_s")
    )

    def scaled(df: DataFrame) -> DataFrame:
        out = df.join(radius, by)
        return out.withColumns({a: (F.col(a) - F.col(f"_c{a}")) / F.col("_s") for a in AXES}).drop("_s", *[f"_c{a}" for a in AXES])

    return scaled(gt), scaled(pr)


def similarity_moments(pr: DataFrame, gt: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row for each group: sizes, means, variance of pr and the 3 x 3 covariance, all by
    partial aggregation."""
    both = renamed(pr.select(*by, key, *AXES), AXES, "p").join(gt.select(*by, key, *AXES), [*by, key])
    p, g = [f"p{a}" for a in AXES], list(AXES)
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in p + g]]
    sums += [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in p + g]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for a in p for b in g]
    return both.groupBy(*by).agg(*sums)


def _procrustes(n: np.ndarray, p: np.ndarray, g: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, rotation and shift of the similarity that takes pr to gt for each group, of its size, the sums
    of both sides (p, g), of pr's squares (q) and of products (m); NaN where a sum is not finite."""
    n = np.maximum(n, 1.0)[:, None]
    mp, mg = p / n, g / n
    cov = m / n[:, :, None] - mp[:, :, None] * mg[:, None, :]
    var = q / n[:, 0] - (mp * mp).sum(axis=1)
    bad = ~(np.isfinite(cov).all(axis=(1, 2)) & np.isfinite(var))
    cov[bad] = 0.0
    u, d, vt = np.linalg.svd(cov)
    back = vt.transpose(0, 2, 1)
    sign = np.ones_like(d)
    sign[:, 2] = np.where(np.linalg.det(back @ u.transpose(0, 2, 1)) < 0, -1.0, 1.0)
    rotation = (back * sign[:, None, :]) @ u.transpose(0, 2, 1)
    wide = var > 1e-12
    scale = np.where(wide, (d * sign).sum(axis=1) / np.where(wide, var, 1.0), 1.0)
    scale[bad] = np.nan
    return scale, rotation, mg - scale[:, None] * (rotation @ mp[:, :, None])[:, :, 0]


SIMILARITY = ["scale", *[f"s{i}{j}" for i in range(3) for j in range(3)], "ux", "uy", "uz"]


def fit_similarity(pr: DataFrame, gt: DataFrame, by: list[str], key: str) -> DataFrame:
    """by..., scale, s00..s22, ux..uz: gt is close to scale S pr + u. The 3 x 3 decomposition is
    made on one row for each group."""
    moments = similarity_moments(pr, gt, by, key)

    def run(parts):
        for rows in parts:
            sums = lambda names: rows[names].to_numpy(float)  # noqa: B023, E731
            m = sums([f"m_p{a}_{b}" for a in AXES for b in AXES]).reshape(-1, 3, 3)
            scale, rotation, shift = _procrustes(rows["n"].to_numpy(float), sums([f"s_p{a}" for a in AXES]), sums([f"s_{a}" for a in AXES]), sums([f"q_p{a}" for a in AXES]).sum(axis=1), m)
            found = pd.DataFrame(np.column_stack([scale, rotation.reshape(-1, 9), shift]), columns=SIMILARITY)
            yield pd.concat([rows[by].reset_index(drop=True), found], axis=1)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*by).schema)
    return moments.mapInPandas(run, keys + ", " + ", ".join(f"{c} double" for c in SIMILARITY))


def apply_similarity(points: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    out = points.join(fitted, by)
    turned = la.apply(la.matrix("s"), la.columns(*AXES))
    moved = [F.col("scale") * t + F.col(u) for t, u in zip(turned, ("ux", "uy", "uz"), strict=True)]
    return out.withColumns(dict(zip(AXES, moved, strict=True))).drop(*SIMILARITY)


def align_first_frame(pr: DataFrame, gt: DataFrame, by=("seq",), key: str = "joint") -> DataFrame:
    """Every frame of pr under the similarity that fits its sequence's first common frame."""
    by = list(by)
    first = gt.join(pr.select(*by, "frame").distinct(), [*by, "frame"], "left_semi").groupBy(*by).agg(F.min("frame").alias("frame"))
    fitted = fit_similarity(pr.join(first, [*by, "frame"]), gt.join(first, [*by, "frame"]), by, key)
    return apply_similarity(pr, fitted, by)


def pa_error(pr: DataFrame, gt: DataFrame, by=FRAME, key: str = "joint", reduction: str = "mean") -> DataFrame:
    """Joint distance after each frame's own similarity; reduction mean, sum or none. Both sides meet
    once: frames are fitted and measured in batches. Joints without all their values have no distance."""
    by = list(by)
    both = renamed(pr.select(*by, key, *AXES), AXES, "p").join(gt.select(*by, key, *AXES), [*by, key])

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first, size = starts[:-1], np.diff(starts)
        p, g = (rows[names].to_numpy(float) for names in ([f"p{a}" for a in AXES], list(AXES)))
        known = np.isfinite(p).all(axis=1) & np.isfinite(g).all(axis=1)
        p0, g0 = (np.where(known[:, None], side, 0.0) for side in (p, g))
        n, *sums = (np.add.reduceat(x, first) for x in (known.astype(float), p0, g0, (p0 * p0).sum(axis=1), p0[:, :, None] * g0[:, None, :]))
        scale, rotation, shift = (np.repeat(x, size, axis=0) for x in _procrustes(n, *sums))
        moved = scale[:, None] * (rotation @ p0[:, :, None])[:, :, 0] + shift
        d = np.where(known, np.sqrt(((moved - g0) ** 2).sum(axis=1)), np.nan)
        if reduction == "none":
            return rows[[*by, key]].assign(pa_error=d)
        total = np.where(n > 0, np.add.reduceat(np.where(known, d, 0.0), first), np.nan)
        return rows[by].iloc[first].assign(pa_error=total / np.maximum(n, 1.0) if reduction == "mean" else total)

    return over_groups(both, by, [key], work, schema_of(both, [*by, key] if reduction == "none" else by) + ", pa_error double")


_R = [f"r{i}{j}" for i in range(3) for j in range(3)]
_T = ["tx", "ty", "tz"]
#: Poses of a task that meets model points, about.
POSES = 20_000


def _places(model: DataFrame) -> DataFrame:
    """Each object's different model points, and how many stand there (_n)."""
    return model.groupBy("object", "mx", "my", "mz").agg(F.count("*").alias("_n"))


def _both_poses(pr: DataFrame, gt: DataFrame, on) -> DataFrame:
    """on..., object and both poses of a frame, the predicted one's columns with a p before."""
    keep = [*on, "object", *_R, *_T]
    return renamed(pr.select(*keep), [*_R, *_T], "p").join(gt.select(*keep), [*on, "object"])


def add_error(pr: DataFrame, gt: DataFrame, model: DataFrame, on=FRAME) -> DataFrame:
    """ADD: mean distance of each object's model points (object, pid, mx, my, mz) under both poses. The
    poses meet first, so that no posed point is moved between tasks."""
    posed = lambda p: la.plus(la.apply(la.matrix(f"{p}r"), la.columns("mx", "my", "mz")), la.columns(*[f"{p}{c}" for c in _T]))
    d = la.norm(la.minus(posed("p"), posed("")))
    apart = with_dimension(_both_poses(pr, gt, on), _places(model), ["object"]).select(*on, d.alias("_d"), "_n")
    mean = F.try_divide(F.sum(F.col("_d") * F.col("_n")), F.sum(F.when(F.col("_d").isNotNull(), F.col("_n"))))
    return apart.groupBy(*on).agg(mean.alias("add"))


def adds_error(pr: DataFrame, gt: DataFrame, model: DataFrame, on=FRAME) -> DataFrame:
    """ADD-S: mean distance from each true model point to the nearest predicted one. A true point seen
    from the predicted pose lies among the model's own points, so that only poses and models are moved.
    Models of more than neighbours.WHOLE different points go through `nearest`."""
    places = _places(model).dropna()
    most = places.groupBy("object").count().agg(F.max("count")).first()[0] or 0
    poses = _both_poses(pr, gt, on)
    if most > WHOLE:
        numbered = places.withColumn("pid", F.row_number().over(Window.partitionBy("object").orderBy("mx", "my", "mz")))
        posed = with_dimension(poses, numbered, ["object"])
        at = lambda p: [m.alias(a) for a, m in zip(AXES, la.plus(la.apply(la.matrix(f"{p}r"), la.columns("mx", "my", "mz")), la.columns(*[f"{p}{c}" for c in _T])), strict=True)]
        near = nearest(posed.select(*on, F.struct("pid", "_n").alias("pid"), *at("")), posed.select(*on, "pid", *at("p")), list(on))
        return near.groupBy(*on).agg((F.sum(F.col("distance") * F.col("pid._n")) / F.sum("pid._n")).alias("adds"))
    back = la.transpose(la.matrix("pr"))
    shift = la.apply(back, la.minus(la.columns(*_T), la.columns(*[f"p{c}" for c in _T])))
    parts = pr.count() // POSES + 1
    seen = poses.select(*on, "object", *la.named(la.times(back, la.matrix("r"))), *[c.alias(n) for c, n in zip(shift, _T, strict=True)], F.pmod(F.xxhash64(*on), F.lit(parts)).alias("_part"))
    spread = places.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(poses: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        m, n = points[["mx", "my", "mz"]].to_numpy(float), points["_n"].to_numpy(float)
        turns, shifts = poses[_R].to_numpy(float).reshape(-1, 3, 3), poses[_T].to_numpy(float)
        out, d2, part = np.full(len(poses), np.nan), np.empty((len(m), len(m))), np.empty((len(m), len(m)))
        for k in range(len(poses)) if len(m) else ():
            moved = m @ turns[k].T + shifts[k]
            for axis in range(3):
                np.subtract.outer(moved[:, axis], m[:, axis], out=part)
                np.multiply(part, part, out=part) if axis else np.multiply(part, part, out=d2)
                if axis:
                    np.add(d2, part, out=d2)
            out[k] = np.sqrt(d2.min(axis=1)) @ n / n.sum()
        return poses[list(on)].assign(adds=out)[lambda x: x["adds"].notna()]

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.select(*on).schema)
    return seen.groupBy("object", "_part").cogroup(spread.groupBy("object", "_part")).applyInPandas(run, keys + ", adds double")


def accuracy_auc(errors: DataFrame, column: str, most: float = 0.1, step: float = 0.001, by=()) -> DataFrame:
    """Area under accuracy against threshold, 0 to `most` by trapezoids, over `most`. Each row's
    share of the area has a closed form in the first threshold that it meets, so one
    aggregation does."""
    n = round(most / step)
    first = F.when(F.col(column) <= 0, 0).otherwise(F.ceil(F.round(F.col(column) / step, 9)))
    # thresholds k >= first count; the two at the ends of the range have half weight
    inside = F.when(first > n, 0.0).otherwise(n - first + 1.0 - 0.5 - F.when(first == 0, 0.5).otherwise(0.0))
    return errors.groupBy(*by).agg((F.avg(inside) / n).alias("auc"))


def decode_contacts(df: DataFrame, column: str, kind: str, threshold: float = 0.0, out: str = "contact") -> DataFrame:
    """Contact from a logit (over 0) or a distance (below the threshold)."""
    return df.withColumn(out, F.col(column) > 0 if kind == "logit" else F.col(column) < threshold)


def contact_accuracy(df: DataFrame, pr: Column, gt: Column, by=()) -> DataFrame:
    """Share of rows on which both agree."""
    return df.groupBy(*by).agg(F.avg((pr == gt).cast("double")).alias("contact_accuracy"))


def contact_distance_error(df: DataFrame, pr: str, gt: str, dims: int = 8, threshold: float = 1.0) -> DataFrame:
    """Mean absolute error of the first `dims` of two distance arrays, of all where they are not
    longer than 32; a threshold of 10 or more counts only entries whose truth is below it."""
    a, b = (F.when(F.size(c) >= 32, F.slice(c, 1, dims)).otherwise(F.col(c)) for c in (pr, gt))
    pairs = F.arrays_zip(a.alias("p"), b.alias("g"))
    if threshold >= 10:
        pairs = F.filter(pairs, lambda x: x["g"] < threshold)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.abs(x["p"] - x["g"]))
    return df.withColumn("contact_distance_error", F.try_divide(total, F.size(pairs)))


def hand_contact_accuracy(hands_pr: DataFrame, hands_gt: DataFrame, points_pr: DataFrame, points_gt: DataFrame, by: list[str], threshold: float = 0.015) -> DataFrame:
    """Share of hand joints whose contact, nearest object point below the threshold, is the same
    in prediction and truth."""
    near = lambda h, p, n: nearest(h, p, by).select(*by, "pid", (F.col("distance") < threshold).alias(n))
    both = near(hands_pr, points_pr, "p").join(near(hands_gt, points_gt, "g"), [*by, "pid"])
    return both.groupBy(*by).agg(F.avg((F.col("p") == F.col("g")).cast("double")).alias("hand_contact_accuracy"))


def summarise(frames: DataFrame, keys: list[str], degrees=("rot_error", "mpjae"), by=()) -> DataFrame:
    """Mean of each metric over all frames, angles in degrees, with the numbers of sequences and
    frames; one row for each `by`, or a rollup's levels."""
    means = [F.avg(F.degrees(k) if k in degrees else F.col(k)).alias(k) for k in keys]
    grouped = frames.rollup(*by) if by else frames.groupBy()
    return grouped.agg(*means, F.count("*").alias("frames"), F.countDistinct("seq").alias("seqs"))


def metric_meter(log: DataFrame, value: str, n: str, by: list[str], order: str, window: int = 20) -> DataFrame:
    """global_avg, the running mean weighted by n; median (lower of two), avg and max of the last
    `window` values."""
    w = Window.partitionBy(*by).orderBy(order)
    run, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - window, 0)
    values = F.array_sort(F.collect_list(value).over(last))
    return (
        log.withColumn("global_avg", F.sum(F.col(value) * F.col(n)).over(run) / F.sum(n).over(run))
        .withColumn("median", values[F.floor((F.size(values) - 1) / 2).cast("int")])
        .withColumn("avg", F.avg(value).over(last))
        .withColumn("max", F.max(value).over(last))
    )


def topk_accuracy(scores: DataFrame, example: str, klass: str, score: str, label: str, ks: list[int]) -> DataFrame:
    """Percentage of examples whose label is among the k best classes, one column for each k."""
    w = Window.partitionBy(example).orderBy(F.desc(score), klass)
    place = scores.withColumn("_p", F.row_number().over(w)).where(F.col(klass) == F.col(label))
    n = scores.agg(F.countDistinct(example).alias("_n"))
    hits = place.agg(*[F.sum((F.col("_p") <= k).cast("long")).alias(f"top{k}") for k in ks])
    both = hits.crossJoin(n)  # one row each
    return both.select(*[(F.coalesce(f"top{k}", F.lit(0)) * 100.0 / F.col("_n")).alias(f"top{k}") for k in ks])


def frame_convention(a: DataFrame, b: DataFrame, by=("seq",), constant_below: float = 5.0) -> DataFrame:
    """Residual rotation between two predictions: range of its angle, the mean rotation vector,
    mean angle to that mean; constant where the spread is below so many degrees."""
    by = list(by)
    r = [f"r{i}{j}" for i in range(3) for j in range(3)]
    both = renamed(b.select(*by, "frame", *r), r, "p").join(a.select(*by, "frame", *r), [*by, "frame"])
    residual = la.times(la.transpose(la.matrix("r")), la.matrix("pr"))
    rows = both.select(*by, "frame", *la.named(residual))
    rows = la.with_rotation_vector(rows, la.matrix("r"), ["vx", "vy", "vz"])
    mean = rows.groupBy(*by).agg(*[F.avg(v).alias(f"m{v}") for v in ("vx", "vy", "vz")])
    spread = F.degrees(la.angle_between(la.matrix("r"), la.from_rotation_vector(la.columns("mvx", "mvy", "mvz"))))
    angle = F.degrees(la.norm(la.columns("vx", "vy", "vz")))
    out = rows.join(mean, by).groupBy(*by, "mvx", "mvy", "mvz").agg(
        F.min(angle).alias("min_angle"), F.max(angle).alias("max_angle"), F.avg(spread).alias("spread")
    )
    return out.withColumn("constant", F.col("spread") < constant_below)


def energy_terms(terms: dict[str, DataFrame], weights: dict[str, float], on=FRAME) -> DataFrame:
    """The weighted sum of per-frame energy terms: `terms` gives each as (on..., value). A frame
    that lacks a term has it as 0. One column for each term, and total."""
    frames = reduce(lambda p, q: p.union(q), [df.select(*on) for df in terms.values()]).distinct()
    for name, df in terms.items():
        frames = frames.join(df.select(*on, F.col("value").alias(name)), list(on), "left")
    frames = frames.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in terms})
    weighted = [F.col(n) * float(weights.get(n, 1.0)) for n in terms]
    return frames.withColumn("total", reduce(lambda p, q: p + q, weighted))
