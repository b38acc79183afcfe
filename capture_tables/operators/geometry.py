"""Several views: centroids, triangulation, residuals, validation, clouds and tracks."""

from __future__ import annotations

from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions import linalg as la
from capture_tables.functions.hashing import uniform
from capture_tables.operators.grouped import over_groups, schema_of
from capture_tables.operators.joins import with_dimension
from capture_tables.operators.neighbours import nearest, nearest_row

AXES = ("x", "y", "z")


def camera_rays(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """World rays of pixels (cam, u, v) of pinhole cameras with world-to-camera r, t: origin ox,
    oy, oz and unit direction dx, dy, dz."""
    out = observations.join(cameras, "cam")
    r, t = la.transpose(la.matrix("r")), la.columns("tx", "ty", "tz")
    local = [(F.col("u") - F.col("cx")) / F.col("fx"), (F.col("v") - F.col("cy")) / F.col("fy"), F.lit(1.0)]
    world = la.apply(r, local)
    size = la.norm(world)
    origin = [-c for c in la.apply(r, t)]
    keep = observations.columns
    return out.select(*keep, *[(w / size).alias(f"d{a}") for w, a in zip(world, AXES, strict=True)], *[o.alias(f"o{a}") for o, a in zip(origin, AXES, strict=True)])


def triangulate(rays: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by..., x, y, z, gap, n_views: the point nearest to all rays of a group, by nine sums and a
    3 x 3 solution; gap is the mean distance to the rays, from the same sums' rows. NULL where the
    rays are parallel."""
    w = F.col(weight) if weight else F.lit(1.0)
    d, o = la.columns("dx", "dy", "dz"), la.columns("ox", "oy", "oz")
    p = [[(F.lit(1.0 if i == j else 0.0) - d[i] * d[j]) * w for j in range(3)] for i in range(3)]
    sums = [F.sum(p[i][j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(la.dot(p[i], o)).alias(f"b{i}") for i in range(3)]
    members = F.collect_list(F.struct("dx", "dy", "dz", "ox", "oy", "oz")).alias("_rays")  # one for each camera of a frame
    solved = rays.groupBy(*by).agg(*sums, F.count("*").alias("n_views"), members)
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    x = la.solve(a, la.columns("b0", "b1", "b2"))
    solved = solved.select(*by, *[c.alias(n) for c, n in zip(x, AXES, strict=True)], "n_views", "_rays")

    def off(ray):
        q = [F.col(n) - ray[f"o{n}"] for n in AXES]
        along = la.dot(q, [ray[f"d{n}"] for n in AXES])
        return F.sqrt(F.greatest(la.dot(q, q) - along * along, F.lit(0.0)))

    gap = F.aggregate(F.transform("_rays", off), F.lit(0.0), lambda s, v: s + v) / F.size("_rays")
    return solved.select(*by, *AXES, "n_views", gap.alias("gap"))


def reprojection_residual(points: DataFrame, observations: DataFrame, cameras: DataFrame, by: list[str], ref_width: float) -> DataFrame:
    """by..., residual: mean pixel distance of the projected points from their observations, in
    pixels of a camera ref_width wide; infinite where a point is behind a camera."""
    out = points.select(*by, *AXES).join(observations.select(*by, "cam", "u", "v"), by).join(cameras, "cam")
    px = la.plus(la.apply(la.matrix("r"), la.columns(*AXES)), la.columns("tx", "ty", "tz"))
    out = out.select(*by, "u", "v", "fx", "fy", "cx", "cy", "width", *[c.alias(f"p{a}") for c, a in zip(px, AXES, strict=True)])
    du = F.col("fx") * F.col("px") / F.col("pz") + F.col("cx") - F.col("u")
    dv = F.col("fy") * F.col("py") / F.col("pz") + F.col("cy") - F.col("v")
    error = F.when(F.col("pz") > 0, F.sqrt(du * du + dv * dv) * ref_width / F.col("width")).otherwise(F.lit(float("inf")))
    return out.groupBy(*by).agg(F.avg(error).alias("residual"))


def triangulate_joints(keypoints: DataFrame, cameras: DataFrame, by: list[str], order: str, least_conf: float, most_residual: float, ref_width: float = 1024.0, least_views: int = 2) -> DataFrame:
    """by..., x, y, z, residual, valid: of each camera the first observation that is confident,
    weighted by its confidence; two views at least; valid within the residual."""
    w = Window.partitionBy(*by, "cam").orderBy(order)
    chosen = keypoints.where(F.col("conf") >= least_conf).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    many = chosen.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= least_views).drop("_n")
    points = triangulate(camera_rays(many.select(*by, "cam", "u", "v", "conf"), cameras), by, "conf")
    residual = reprojection_residual(points, many, cameras, by, ref_width)
    return points.join(residual, by, "left").withColumn("valid", F.coalesce(F.col("residual") <= most_residual, F.lit(False)))


def triangulate_best(combos: DataFrame, cameras: DataFrame, by: list[str], ref_width: float = 1024.0) -> DataFrame:
    """Of each frame's combinations (by..., combo, cam, u, v) the one with the smallest residual,
    ties to the first: by..., combo, x, y, z, n_views, residual."""
    keys = [*by, "combo"]
    points = triangulate(camera_rays(combos.select(*keys, "cam", "u", "v"), cameras), keys)
    scored = points.join(reprojection_residual(points, combos, cameras, keys, ref_width), keys).where("x is not null")
    w = Window.partitionBy(*by).orderBy("residual", "combo")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "gap")


#: So many choices of observations are solved and measured at once.
CHOICES = 50_000
_MOMENTS = [f"a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"b{i}" for i in range(3)]


def triangulate_frames(observations: DataFrame, cameras: DataFrame, by: list[str], cap: int | None = None, ref_width: float = 1024.0) -> DataFrame:
    """by..., combo, x, y, z, n_views, residual: of all choices of one observation (by..., cam, obs, u, v)
    for each camera of a frame the one whose point has the smallest mean residual, ties to the first;
    combos as in joins.observation_combos. Where a `cap` is given, frames with more choices have the first
    alone. A frame's observations meet once, with their rays' moments; a choice adds up those of its
    observations. Frames whose cameras have the same numbers of observations are solved and measured
    together, CHOICES of them at once."""
    rays = camera_rays(observations.select(*by, "cam", "obs", "u", "v"), cameras)
    d, o = la.columns("dx", "dy", "dz"), la.columns("ox", "oy", "oz")
    p = [[F.lit(1.0 if i == j else 0.0) - d[i] * d[j] for j in range(3)] for i in range(3)]
    moments = [p[i][j] for i in range(3) for j in range(i, 3)] + [la.dot(p[i], o) for i in range(3)]
    camera = ["fx", "fy", "cx", "cy", "width", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
    known = with_dimension(rays, cameras.select("cam", *camera), ["cam"]).withColumns(dict(zip(_MOMENTS, moments, strict=True)))
    names = ["u", "v", *_MOMENTS, *camera]

    def best_of(value: dict[str, np.ndarray], first: np.ndarray, sizes: tuple[int, ...], choices: range) -> tuple[np.ndarray, ...]:
        """Whether there is one, residual, combo, x, y, z of these choices of frames whose cameras have so many observations;
        `first` are their rows."""
        places = list(np.unravel_index(np.arange(choices.start, choices.stop), sizes))
        begin = np.cumsum([0, *sizes[:-1]])
        at = [first[:, None] + b + p[None] for b, p in zip(begin, places, strict=True)]
        sums = {m: sum((value[m][k] for k in at), 0.0) for m in _MOMENTS}
        m = [[sums[f"a{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]
        v = [sums[f"b{i}"] for i in range(3)]
        det = la.determinant(m)
        solid = np.abs(det) > 1e-9
        x = [la.determinant([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / np.where(solid, det, 1.0) for k in range(3)]
        total = 0.0
        for k in at:
            c = {name: value[name][k] for name in ("u", "v", *camera)}
            px, py, pz = (c[f"r{i}0"] * x[0] + c[f"r{i}1"] * x[1] + c[f"r{i}2"] * x[2] + c[t] for i, t in enumerate(("tx", "ty", "tz")))
            ahead = pz > 0
            depth = np.where(ahead, pz, 1.0)
            du, dv = c["fx"] * px / depth + c["cx"] - c["u"], c["fy"] * py / depth + c["cy"] - c["v"]
            total = total + np.where(ahead, np.sqrt(du * du + dv * dv) * ref_width / c["width"], np.inf)
        residual = np.where(solid & ~np.isnan(total), total / len(sizes), np.inf)
        # a choice behind a camera still comes before one without a point
        least = np.where(solid, residual, np.nan)
        some = solid.any(axis=1)
        pick = np.nanargmin(np.where(some[:, None], least, 0.0), axis=1)
        rows = np.arange(len(first))
        return some, least[rows, pick], choices.start + pick, *(c[rows, pick] for c in x)

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        value = {name: rows[name].to_numpy(float) for name in names}
        cam = rows["cam"].to_numpy()
        new = np.union1d(np.flatnonzero(cam[1:] != cam[:-1]) + 1, starts)
        shapes: dict[tuple[int, ...], list[int]] = {}
        inside = np.searchsorted(new, starts)
        length = np.diff(new).tolist()
        for k, (p, q) in enumerate(zip(inside[:-1].tolist(), inside[1:].tolist(), strict=True)):
            shapes.setdefault(tuple(length[p:q]), []).append(k)
        out = []
        for sizes, groups in shapes.items():
            n = prod(sizes)
            if cap is not None and n > cap:
                n = 1
            step = max(1, CHOICES // n)
            for lo in range(0, len(groups), step):
                first = starts[groups[lo : lo + step]]
                best = best_of(value, first, sizes, range(min(n, CHOICES)))
                for at in range(CHOICES, n, CHOICES):
                    other = best_of(value, first, sizes, range(at, min(n, at + CHOICES)))
                    better = other[0] & (~best[0] | (other[1] < best[1]))
                    best = tuple(np.where(better, p, q) for p, q in zip(other, best, strict=True))
                some, residual, combo, *point = best
                found = rows[by].iloc[first].reset_index(drop=True).assign(combo=combo, **dict(zip(AXES, point, strict=True)), n_views=len(sizes), residual=residual)
                out.append(found[some])
        return pd.concat(out)

    picked = known.select(*by, "cam", "obs", *[F.col(n).cast("double").alias(n) for n in names])
    return over_groups(picked, by, ["cam", "obs", "u", "v"], work, schema_of(picked, by) + ", combo long, x double, y double, z double, n_views long, residual double")


def triangulate_clicks(clicks: DataFrame, cameras: DataFrame, most_residual: float, ref_width: float = 1024.0) -> DataFrame:
    """Static named points: point, x, y, z, n_views, residual, flagged where it is over the most."""
    points = triangulate(camera_rays(clicks.select("point", "cam", "u", "v"), cameras), ["point"])
    out = points.join(reprojection_residual(points, clicks, cameras, ["point"], ref_width), "point")
    return out.drop("gap").withColumn("flagged", F.col("residual") > most_residual)


def coverage_report(track: DataFrame, by: list[str], most_residual: float) -> DataFrame:
    """by..., frames, two_views, more_views, within (%), median and p90 residual, median and largest
    step between successive rows, and the frames of lowest and highest z."""
    w = Window.partitionBy(*by).orderBy("frame")
    step = la.norm([F.col(a) - F.lag(a).over(w) for a in AXES])
    return track.withColumn("_s", step).groupBy(*by).agg(
        F.count("*").alias("frames"),
        F.sum((F.col("n_views") == 2).cast("long")).alias("two_views"),
        F.sum((F.col("n_views") > 2).cast("long")).alias("more_views"),
        (F.avg((F.col("residual") <= most_residual).cast("double")) * 100.0).alias("within"),
        F.median("residual").alias("median_residual"),
        F.percentile("residual", 0.9).alias("p90_residual"),
        F.median("_s").alias("median_step"),
        F.max("_s").alias("max_step"),
        F.min(F.struct("z", "frame"))["frame"].alias("lowest_frame"),
        F.max(F.struct("z", "frame"))["frame"].alias("highest_frame"),
    )


def compare_camera_models(track: DataFrame, centroids: DataFrame, pinhole: DataFrame, fisheye: DataFrame, on: list[str]) -> DataFrame:
    """For each camera the median pixel error of both projections (on..., cam, u, v) against the
    centroids, the better model and metres per pixel at the median depth."""
    out = centroids.select(*on, "cam", F.col("u").alias("cu"), F.col("v").alias("cv"))
    for name, df in (("pinhole", pinhole), ("fisheye", fisheye)):
        out = out.join(df.select(*on, "cam", F.col("u").alias(f"{name}_u"), F.col("v").alias(f"{name}_v")), [*on, "cam"])
    out = out.join(track.select(*on, "cam", "z", "fx"), [*on, "cam"])
    error = lambda n: F.sqrt(F.pow(F.col(f"{n}_u") - F.col("cu"), 2) + F.pow(F.col(f"{n}_v") - F.col("cv"), 2))
    report = out.groupBy("cam").agg(
        F.median(error("pinhole")).alias("pinhole_error"), F.median(error("fisheye")).alias("fisheye_error"), F.median(F.col("z") / F.col("fx")).alias("metres_per_pixel")
    )
    return report.withColumn("better", F.when(F.col("pinhole_error") <= F.col("fisheye_error"), "pinhole").otherwise("fisheye"))


def validate_reprojection(projected: DataFrame, observed: DataFrame, on: list[str], by: list[str], centre: tuple[float, float], passes_below: float = 15.0) -> DataFrame:
    """by..., n, median, mean and worst pixel error, its correlation with the distance from the
    image centre, and passed."""
    both = projected.select(*on, "u", "v").join(observed.select(*on, F.col("u").alias("ou"), F.col("v").alias("ov")), on)
    error = F.sqrt(F.pow(F.col("u") - F.col("ou"), 2) + F.pow(F.col("v") - F.col("ov"), 2))
    radius = F.sqrt(F.pow(F.col("ou") - centre[0], 2) + F.pow(F.col("ov") - centre[1], 2))
    report = both.withColumn("_e", error).withColumn("_r", radius).groupBy(*by).agg(
        F.count("*").alias("n"), F.median("_e").alias("median"), F.avg("_e").alias("mean"), F.max("_e").alias("worst"), F.corr("_r", "_e").alias("corr")
    )
    return report.withColumn("passed", F.col("median") < passes_below)


def voxel_downsample(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    """The mean of each occupied cube of the given edge: by..., x, y, z, n."""
    cells = [F.floor(F.col(a) / F.lit(size)).alias(f"_{a}") for a in AXES]
    return points.groupBy(*by, *cells).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n")).drop(*[f"_{a}" for a in AXES])


def contact_distances(joints: DataFrame, points: DataFrame, by: list[str], key: str, squared: bool = True) -> DataFrame:
    """by..., key, distance to the nearest object point and that point, px, py, pz."""
    named = points.select(*by, *AXES, "pid", *[F.col(a).alias(f"p{a}") for a in AXES])
    best = nearest_row(joints, named, by, key, ["pid", "px", "py", "pz"])
    d = F.col("best.d2") if squared else F.sqrt("best.d2")
    return best.select(*by, key, d.alias("distance"), "best._keep.pid", *[f"best._keep.p{a}" for a in AXES])


def point_triangle_distance(df: DataFrame) -> DataFrame:
    """distance of the point p (px, py, pz) from the triangle a, b, c (ax .. cz), in one
    projection by regions; degenerate triangles count as their edges."""
    p, a, b, c = ([F.col(f"{v}{n}") for n in AXES] for v in "pabc")

    def to_edge(u, v):
        e, q = la.minus(v, u), la.minus(p, u)
        size = la.dot(e, e)
        s = la.clip(F.coalesce(F.try_divide(la.dot(q, e), size), F.lit(0.0)), 0.0, 1.0)
        return la.norm(la.minus(q, [x * s for x in e]))

    ab, ac, ap = la.minus(b, a), la.minus(c, a), la.minus(p, a)
    d00, d01, d11, d20, d21 = la.dot(ab, ab), la.dot(ab, ac), la.dot(ac, ac), la.dot(ap, ab), la.dot(ap, ac)
    det = d00 * d11 - d01 * d01
    v, w = F.try_divide(d11 * d20 - d01 * d21, det), F.try_divide(d00 * d21 - d01 * d20, det)
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    foot = [x - v * y - w * z for x, y, z in zip(ap, ab, ac, strict=True)]
    edge = F.least(to_edge(a, b), to_edge(b, c), to_edge(a, c))
    return df.withColumn("distance", F.when(F.coalesce(inside, F.lit(False)), la.norm(foot)).otherwise(edge))


def sample_surface(faces: DataFrame, n: int, seed: int, by: list[str], face: str) -> DataFrame:
    """n points for each mesh, spread over its faces by area: by..., draw, face, x, y, z. Each draw's
    place in the cumulative area comes from an even grid shifted by a hash, so that a face's number
    of draws follows from its own cumulative bounds, and no join is needed."""
    a, b, c = ([F.col(f"{v}{k}") for k in AXES] for v in "abc")
    e, f = la.minus(b, a), la.minus(c, a)
    cross = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    w = Window.partitionBy(*by)
    sized = faces.withColumn("_area", la.norm(cross) / 2.0)
    sized = sized.withColumn("_until", F.sum("_area").over(w.orderBy(face).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_area").over(w))
    shift = uniform(seed, *by)
    lo = F.greatest(F.ceil((F.col("_until") - F.col("_area")) / F.col("_all") * n - shift), F.lit(0)).cast("int")
    hi = F.least(F.ceil(F.col("_until") / F.col("_all") * n - shift), F.lit(n)).cast("int")
    drawn = sized.where("_all > 0").withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo")
    drawn = drawn.withColumn("draw", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    root, t = F.sqrt(uniform(seed + 1, *by, "draw")), uniform(seed + 2, *by, "draw")
    point = [(1.0 - root) * i + root * (1.0 - t) * j + root * t * k for i, j, k in zip(a, b, c, strict=True)]
    return drawn.select(*by, "draw", face, *[v.alias(k) for v, k in zip(point, AXES, strict=True)])


#: Directions along which a cloud's extreme points bound its diameter from below, and cells along an axis.
_DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
_CELLS = 16


def cloud_diameter(points: DataFrame, by: list[str]) -> DataFrame:
    """by..., diameter: the largest distance between two of a cloud's points. The extremes along a few
    directions bound it from below. Points too near the middle to reach that bound go; the others meet
    by cells of a grid, and only cells whose farthest corners reach it."""
    cloud = points.select(*by, *AXES).dropna(subset=list(AXES)).distinct()
    here = F.struct(*AXES)
    ends, spans = [], []
    for k, way in enumerate(_DIRECTIONS):
        along = la.total(F.col(a) * float(w) for a, w in zip(AXES, way, strict=True) if w)
        ends += [F.min_by(here, along).alias(f"_p{k}"), F.max_by(here, along).alias(f"_q{k}")]
        spans.append(la.norm([F.col(f"_p{k}.{a}") - F.col(f"_q{k}.{a}") for a in AXES]))
    box = [f(a).alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]
    known = cloud.groupBy(*by).agg(*ends, *box).select(*by, F.greatest(*spans).alias("_least"), *[f"_{n}{a}" for n in ("lo", "hi") for a in AXES])
    radius = la.norm([F.col(a) - (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2.0 for a in AXES])
    placed = with_dimension(cloud, known, by).withColumn("_r", radius)
    known = placed.groupBy(*by, "_least").agg(F.max("_r").alias("_far"))
    cell = [F.floor((F.col(a) - F.col(f"_lo{a}")) / F.when(F.col(f"_hi{a}") > F.col(f"_lo{a}"), F.col(f"_hi{a}") - F.col(f"_lo{a}")).otherwise(1.0) * _CELLS) for a in AXES]
    slack = 1.0 - 1e-9
    outer = with_dimension(placed.drop("_least"), known, by).where(F.col("_r") + F.col("_far") >= F.col("_least") * slack)
    outer = outer.select(*by, "_least", *AXES, F.struct(*[c.alias(a) for a, c in zip(AXES, cell, strict=True)]).alias("_cell"))
    boxes = outer.groupBy(*by, "_least", "_cell").agg(*[f(a).alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES])
    other = boxes.select(*by, F.col("_cell").alias("_other"), *[F.col(f"_{n}{a}").alias(f"_o{n}{a}") for n in ("lo", "hi") for a in AXES])
    reach = la.norm([F.greatest(F.col(f"_hi{a}") - F.col(f"_olo{a}"), F.col(f"_ohi{a}") - F.col(f"_lo{a}")) for a in AXES])
    met = boxes.join(other, by).where((F.col("_cell") <= F.col("_other")) & (reach >= F.col("_least") * slack)).select(*by, "_cell", "_other")
    right = outer.select(*by, F.col("_cell").alias("_other"), *[F.col(a).alias(f"_{a}") for a in AXES])
    d = la.norm([F.col(a) - F.col(f"_{a}") for a in AXES])
    return outer.join(met, [*by, "_cell"]).join(right, [*by, "_other"]).groupBy(*by).agg(F.max(d).alias("diameter"))


def covariance(points: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, means and the population covariance c00 .. c22, by partial aggregation."""
    sums = [F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES]]
    sums += [F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(AXES) for j, b in enumerate(AXES) if i <= j]
    return points.groupBy(*by).agg(*sums)


def principal_axes(points: DataFrame, by: list[str]) -> DataFrame:
    """by..., a00 .. a22: unit axes as rows, of largest spread first, each with its largest entry
    positive; the decomposition is of one row for each group."""
    names = [f"a{i}{j}" for i in range(3) for j in range(3)]
    moments = covariance(points, by)

    def run(parts):
        for rows in parts:
            flat = np.array([[[getattr(r, f"c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)] for r in rows.itertuples()]).reshape(-1, 3, 3)
            _, vectors = np.linalg.eigh(flat)
            axes = vectors[:, :, ::-1].transpose(0, 2, 1)
            peak = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], axis=2)
            axes = axes * np.sign(peak)
            yield pd.concat([rows[by].reset_index(drop=True), pd.DataFrame(axes.reshape(-1, 9), columns=names)], axis=1)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*by).schema)
    return moments.mapInPandas(run, keys + ", " + ", ".join(f"{n} double" for n in names))


def is_flipped(a: DataFrame, b: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """by..., dot of the first principal axes and flipped where its size is below the least."""
    other = principal_axes(b, by).withColumnsRenamed({f"a0{j}": f"b{j}" for j in range(3)})
    both = principal_axes(a, by).select(*by, "a00", "a01", "a02").join(other.select(*by, "b0", "b1", "b2"), by)
    dot = F.abs(la.dot(la.columns("a00", "a01", "a02"), la.columns("b0", "b1", "b2")))
    return both.select(*by, dot.alias("dot"), (dot < least).alias("flipped"))


def symmetry_table(info: DataFrame, step: int = 5) -> DataFrame:
    """object, sym_id, s00 .. s22 for objects with a continuous axis (ax, ay, az), a turn every
    `step` degrees; an object without axis has the identity alone."""
    turns = F.when(F.col("ax").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(360 - step), F.lit(step)))
    rows = info.withColumn("angle", F.explode(turns))
    axis = [F.coalesce(F.col(f"a{n}"), F.lit(d)) for n, d in zip(AXES, (0.0, 0.0, 1.0), strict=True)]
    turned = la.from_axis_angle(axis, F.radians(F.col("angle").cast("double")))
    return rows.select("object", (F.col("angle") / step).cast("int").alias("sym_id"), *la.named(turned, "s"))


def ray_error_split(track: DataFrame, reference: DataFrame, on: list[str], camera: tuple[float, float, float]) -> DataFrame:
    """along and across: the error from the reference, split by the viewing ray of the camera
    through the reference point."""
    ref = reference.select(*on, *[F.col(a).alias(f"r{a}") for a in AXES])
    both = track.select(*on, *AXES).join(ref, on)
    ray = [F.col(f"r{a}") - float(c) for a, c in zip(AXES, camera, strict=True)]
    error = [F.col(a) - F.col(f"r{a}") for a in AXES]
    along = la.dot(error, ray) / la.norm(ray)
    out = both.withColumn("along", along)
    return out.withColumn("across", F.sqrt(F.greatest(la.dot(error, error) - F.col("along") * F.col("along"), F.lit(0.0)))).select(*on, "along", "across")


def stage_drop(tracks: DataFrame, by: list[str]) -> DataFrame:
    """by..., min_z, its frame, and the drop from the first row's z."""
    first = F.min(F.struct("frame", "z"))["z"]
    low = F.min(F.struct("z", "frame"))
    return tracks.groupBy(*by).agg(low.alias("_l"), first.alias("_f")).select(*by, F.col("_l.z").alias("min_z"), F.col("_l.frame").alias("min_frame"), (F.col("_f") - F.col("_l.z")).alias("drop"))


def mean_shape(human: DataFrame, by: list[str], column: str = "betas") -> DataFrame:
    """Every row with its group's mean of an array column, entry by entry, in mean_<column>."""
    entry = human.select(*by, F.posexplode(column).alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    mean = entry.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))
    return human.join(mean.select(*by, F.transform("_l", lambda x: x["_m"]).alias(f"mean_{column}")), by)


def pose_prior_score(poses: DataFrame, mean: DataFrame, factor: DataFrame, on: list[str]) -> DataFrame:
    """on..., score: squared length of (pose - mean) L; mean is (dim, m), the factor (dim, out, w)."""
    from capture_tables.operators.joins import with_dimension

    dims = poses.select(*on, F.posexplode("pose").alias("dim", "_v"))
    centred = with_dimension(dims, mean, ["dim"]).select(*on, "dim", (F.col("_v") - F.col("m")).alias("_d"))
    product = with_dimension(centred, factor, ["dim"]).groupBy(*on, "out").agg(F.sum(F.col("_d") * F.col("w")).alias("_p"))
    return product.groupBy(*on).agg(F.sum(F.col("_p") * F.col("_p")).alias("score"))


def floor_check(joints: DataFrame, feet: list[int], object_floor: DataFrame, by: list[str], agree_below: float = 0.06) -> DataFrame:
    """by..., floor (10th percentile of the lowest foot joint's z over frames), gap to the floor
    that the object implies (by..., object_floor), agrees."""
    low = joints.where(F.col("joint").isin(feet)).groupBy(*by, "frame").agg(F.min("z").alias("_z"))
    out = low.groupBy(*by).agg(F.percentile("_z", 0.1).alias("floor")).join(object_floor, by)
    out = out.withColumn("gap", F.col("floor") - F.col("object_floor"))
    return out.withColumn("agrees", F.abs(F.round("gap", 9)) < agree_below).drop("object_floor")


def hand_object_gap(wrists: DataFrame, objects: DataFrame, by: list[str], lo: int, hi: int) -> DataFrame:
    """by..., median, mean and population deviation over frames of [lo, hi] of the nearer wrist's
    distance from the camera less the object's (columns dist)."""
    near = wrists.where(F.col("frame").between(lo, hi)).groupBy(*by, "frame").agg(F.min("dist").alias("_w"))
    both = near.join(objects.select(*by, "frame", F.col("dist").alias("_o")), [*by, "frame"]).withColumn("_g", F.col("_w") - F.col("_o"))
    return both.groupBy(*by).agg(F.median("_g").alias("median"), F.avg("_g").alias("mean"), F.stddev_pop("_g").alias("std"))


def cluster_poses(hypotheses: DataFrame, symmetries: DataFrame | None, by: list[str], score: str, key: str, angle: float, distance: float) -> DataFrame:
    """cluster: hypotheses in score order join the first earlier representative within both the
    angle (radians, over any symmetry) and the distance, or start a cluster. The order decides, so
    each group, a frame's hypotheses, is one vectorised pass over its representatives."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    base = hypotheses
    if symmetries is not None:
        cells = [f"s{i}{j}" for i in range(3) for j in range(3)]
        listed = symmetries.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("sym_id", F.array(*cells).alias("m")))).alias("_s"))
        base = hypotheses.join(listed.select("object", F.transform("_s", lambda x: x["m"]).alias("_sym")), "object", "left")
    else:
        base = hypotheses.withColumn("_sym", F.lit(None).cast("array<array<double>>"))

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        turn = rows[names].to_numpy(float).reshape(-1, 3, 3)
        place = rows[["tx", "ty", "tz"]].to_numpy(float)
        objects = rows["object"].tolist()
        known: dict = {}
        for k, o in enumerate(objects):
            if o not in known:
                own = rows["_sym"].iloc[k]
                known[o] = np.eye(3)[None] if own is None else np.array([np.array(m, float) for m in own]).reshape(-1, 3, 3)
        cluster = np.empty(len(rows), np.int64)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kept: list[int] = []
            for k in range(lo, hi):
                if kept:
                    turned = (turn[k] @ known[objects[k]]).reshape(-1, 9)
                    trace = (turn[kept].reshape(-1, 9) @ turned.T).max(axis=1)
                    apart = place[kept] - place[k]
                    near = (np.arccos(np.clip((trace - 1) / 2, -1, 1)) <= angle) & (np.sqrt((apart * apart).sum(axis=1)) <= distance)
                    first = int(near.argmax())
                    if near[first]:
                        cluster[k] = first
                        continue
                cluster[k] = len(kept)
                kept.append(k)
        return rows[[*by, key]].assign(cluster=cluster)

    picked = base.select(*by, key, score, "object", *names, "tx", "ty", "tz", "_sym")
    return over_groups(picked, by, [F.desc(score), key], work, schema_of(base, [*by, key]) + ", cluster long")


def fuse_views(depth: DataFrame, masks: DataFrame, cameras: DataFrame, by: list[str]) -> DataFrame:
    """by..., cam, x, y, z in the world of depth pixels inside the object's mask; of frames whose
    masks hold no pixel, all pixels."""
    keyed = depth.join(masks.select(*by, "v", "u0", "u1"), [*by, "v"], "left")
    inside = F.coalesce((F.col("u") >= F.col("u0")) & (F.col("u") < F.col("u1")), F.lit(False))
    one = keyed.groupBy(*by, "cam", "v", "u", "z").agg(F.bool_or(inside).alias("_in"))
    some = F.bool_or("_in").over(Window.partitionBy(*by))
    kept = one.withColumn("_some", some).where("_in or not _some")
    out = kept.join(cameras, "cam")
    local = [(F.col("u") - F.col("cx")) * F.col("z") / F.col("fx"), (F.col("v") - F.col("cy")) * F.col("z") / F.col("fy"), F.col("z")]
    world = la.apply(la.transpose(la.matrix("r")), la.minus(local, la.columns("tx", "ty", "tz")))
    return out.select(*by, "cam", *[w.alias(a) for w, a in zip(world, AXES, strict=True)])


def scale_candidates(ranges: DataFrame, n: int, by: list[str]) -> DataFrame:
    """by..., k, scale: n scales evenly from lo to hi."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return ranges.select(*by, "lo", "hi", k.alias("k")).select(*by, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / F.lit(float(max(1, n - 1)))).alias("scale"))


def pick_scale(candidates: DataFrame, source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """by..., k, scale, score: the mean distance from the source points, scaled about their
    centroid, to the nearest target point; one row for each candidate."""
    centre = source.groupBy(*by).agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    scaled = source.join(centre, by).join(candidates, by)
    moved = scaled.withColumns({a: F.col(f"_c{a}") + (F.col(a) - F.col(f"_c{a}")) * F.col("scale") for a in AXES})
    # all candidates meet one target: a copy for each would be dealt and bounded anew
    asks = moved.select(*by, F.struct("k", "pid").alias("_ask"), *AXES)
    near = nearest_row(asks, target.withColumn("_one", F.lit(1)), by, "_ask", ["_one"])
    found = near.select(*by, F.col("_ask.k").alias("k"), F.sqrt("best.d2").alias("distance"))
    return found.groupBy(*by, "k").agg(F.avg("distance").alias("score")).join(candidates, [*by, "k"])


def _thinned(points: np.ndarray, voxel: float) -> np.ndarray:
    """The mean point of each voxel of a grid that starts half a voxel below the smallest."""
    cell = np.floor((points - points.min(axis=0) + voxel / 2) / voxel).astype(np.int64)
    _, at, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
    return np.stack([np.bincount(at.ravel(), points[:, k]) / n for k in range(3)], axis=1)


def _moved_onto(source: np.ndarray, target: np.ndarray, shift: float, voxel: float, iterations, tolerance: float) -> tuple[float, int]:
    """(shift in z, inliers) by the mean z of the nearest target points within twice the radius."""
    inliers, target = 0, _thinned(target, voxel)
    target = target[np.argsort(target[:, 0], kind="stable")]
    for wide, rounds in zip((8, 4, 1), iterations, strict=True):
        points, reach = _thinned(source + [0, 0, shift], voxel), 2 * wide * voxel
        points = points[np.argsort(points[:, 0], kind="stable")]
        for _ in range(rounds):
            steps = []
            for lo in range(0, len(points), 256):  # neighbours in x, against the targets about them
                part = points[lo : lo + 256]
                first, last = np.searchsorted(target[:, 0], (part[0, 0] - reach, part[-1, 0] + reach))
                near = target[first:last]
                if len(near):
                    d2 = ((part[:, None] - near[None]) ** 2).sum(axis=2)
                    at = d2.argmin(axis=1)
                    ok = d2[np.arange(len(part)), at] < reach**2
                    steps.append((near[at, 2] - part[:, 2])[ok])
            found = np.concatenate(steps) if steps else np.empty(0)
            inliers = len(found)
            if not inliers or abs(step := float(found.mean())) < tolerance:
                break
            points[:, 2] += step
            shift += step
    return shift, inliers


def register_z(source: DataFrame, target: DataFrame, by: list[str], voxel: float = 0.01, iterations=((25, 10, 5), (15, 15, 15)), tolerance: float = 0.001, nearest_z: float = 1.0) -> DataFrame:
    """by..., z_shift, scale, inliers: the source cloud scaled and moved along z onto the target.

    It starts at the difference of the median depths. Both clouds are thinned to voxels; for
    radii of 8, 4 and 1 voxels, points whose nearest target point is within twice the radius
    move the cloud by their mean difference in z, unless that is below the tolerance. The ratio
    of the mean depths after and before is the scale; the scaled cloud then starts again at its
    median depth. NULL where the cloud ends nearer than nearest_z. Groups, the frames of a
    camera, run in parallel."""
    both = source.select(*by, *AXES, F.lit(0).alias("_side")).unionByName(target.select(*by, *AXES, F.lit(1).alias("_side")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*by).schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["_side"].to_numpy()
        xyz = rows[list(AXES)].to_numpy(float)
        xyz, side = xyz[np.isfinite(xyz).all(axis=1)], side[np.isfinite(xyz).all(axis=1)]
        a, b = xyz[side == 0], xyz[side == 1]
        out = rows[by].iloc[:1].reset_index(drop=True)
        if not len(a) or not len(b) or np.mean(a[:, 2]) <= 0:
            return out.assign(z_shift=None, scale=None, inliers=0)
        middle = np.median(b[:, 2])
        shift, _ = _moved_onto(a, b, middle - np.median(a[:, 2]), voxel, iterations[0], tolerance)
        scale = (shift + np.mean(a[:, 2])) / np.mean(a[:, 2])
        shift, inliers = _moved_onto(a * scale, b, middle - np.median(a[:, 2]) * scale, voxel, iterations[1], tolerance)
        good = np.mean(a[:, 2]) * scale + shift >= nearest_z
        return out.assign(z_shift=shift if good else None, scale=scale if good else None, inliers=inliers)

    return both.groupBy(*by).applyInPandas(run, fields + ", z_shift double, scale double, inliers long")
