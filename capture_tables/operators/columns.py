"""Projections and filters: names, keys, cameras, rotations, perturbations and pixels.

All are Column expressions but the inverse of the 15-parameter lens, an iteration that runs
vectorised over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions import linalg as la
from capture_tables.functions.hashing import normal, uniform

AXES = ("x", "y", "z")


def with_seq_fields(df: DataFrame, genders: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """date, subject, object, action, dataset and valid from names Date_Sub_object_action; gender
    by subject where a lookup (subject, gender) is given."""
    part = F.split(seq, "_")
    out = (
        df.withColumn("date", F.get(part, F.lit(0)))
        .withColumn("subject", F.get(part, F.lit(1)))
        .withColumn("object", F.get(part, F.lit(2)))
        .withColumn("action", F.when(F.size(part) > 3, F.array_join(F.slice(part, 4, 99), "_")))
        .withColumn("valid", F.col(seq).rlike(r"^Date\d+_Sub\d+_[A-Za-z0-9-]+(_.+)?$"))
    )
    out = out.withColumn("dataset", F.when(F.startswith("date", F.lit("Date0")), "indoor").when(F.startswith("date", F.lit("Date")), "outdoor").otherwise("other"))
    return out if genders is None else out.join(genders, "subject", "left")


def with_frame_key(df: DataFrame, key: str, fps: float = 30.0) -> DataFrame:
    """t_sec and frame_idx of keys like t0003.000 or 000123, alone or behind a slash; seconds_key
    and index_key write them back."""
    last = F.element_at(F.split(key, "/"), -1)
    seconds = F.regexp_extract(last, r"^t(\d+\.\d+)$", 1)
    number = F.regexp_extract(last, r"^(\d+)$", 1)
    t = F.when(seconds != "", seconds.cast("double")).otherwise(F.when(number != "", number.cast("double") / fps))
    i = F.when(number != "", number.cast("int")).otherwise(F.when(seconds != "", F.round(seconds.cast("double") * fps).cast("int")))
    out = df.withColumn("t_sec", t).withColumn("frame_idx", i)
    return out.withColumn("seconds_key", F.format_string("t%08.3f", "t_sec")).withColumn("index_key", F.lpad(F.col("frame_idx").cast("string"), 6, "0"))


def time_grid(ranges: DataFrame, fps: float = 30.0, by=("seq",)) -> DataFrame:
    """by..., k, t: t_start + k / fps below t_end - 1 / fps, kept where rounded to milliseconds it
    lies in [lo, hi]."""
    n = F.ceil(F.round((F.col("t_end") - 1.0 / fps - F.col("t_start")) * fps, 6)).cast("int")
    grid = ranges.where(n > 0).select(*by, "t_start", "lo", "hi", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return grid.withColumn("t", F.col("t_start") + F.col("k") / F.lit(fps)).where(F.round("t", 3).between(F.col("lo"), F.col("hi"))).select(*by, "k", "t")


def common_range(times: DataFrame, time: str, by=("seq",), camera: str = "cam") -> DataFrame:
    """start: the latest of the cameras' starts; end: the earliest of their ends."""
    each = times.groupBy(*by, camera).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return each.groupBy(*by).agg(F.max("a").alias("start"), F.min("b").alias("end"))


def valid_depth(df: DataFrame, far: float, near: float = 0.001) -> DataFrame:
    """Pixels of depth near <= z < far."""
    return df.where((F.col("z") >= near) & (F.col("z") < far))


def backproject(depth: DataFrame, cameras: DataFrame) -> DataFrame:
    """x, y, z of depth pixels (cam, u, v, z) by the pinhole model; the pixel's z stays."""
    out = depth.join(cameras.select("cam", "fx", "fy", "cx", "cy"), "cam")
    return out.withColumn("x", (F.col("u") - F.col("cx")) * F.col("z") / F.col("fx")).withColumn("y", (F.col("v") - F.col("cy")) * F.col("z") / F.col("fy")).drop("fx", "fy", "cx", "cy")


def project_pinhole(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """u, v of camera-frame points; NULL where z is not in front."""
    out = points.join(cameras.select("cam", "fx", "fy", "cx", "cy"), "cam")
    front = F.when(F.col("z") > 0, F.col("z"))
    return out.withColumn("u", F.col("fx") * F.col("x") / front + F.col("cx")).withColumn("v", F.col("fy") * F.col("y") / front + F.col("cy")).drop("fx", "fy", "cx", "cy")


def project_kb(df: DataFrame, k=("k1", "k2", "k3", "k4")) -> DataFrame:
    """Four-coefficient fisheye: u, v of camera-frame points, with fx, fy, cx, cy and k in columns;
    NULL behind the camera."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    theta = F.atan2(r, F.col("z"))
    out = df.withColumn("_t2", theta * theta).withColumn("_theta", theta).withColumn("_r", r)
    t2 = F.col("_t2")
    bent = F.col("_theta") * (1.0 + t2 * (F.col(k[0]) + t2 * (F.col(k[1]) + t2 * (F.col(k[2]) + t2 * F.col(k[3])))))
    scale = F.when(F.col("z") > 0, F.when(F.col("_r") > 1e-9, bent / F.col("_r")).otherwise(1.0 / F.col("z")))
    out = out.withColumn("_s", scale)
    return out.withColumn("u", F.col("fx") * F.col("x") * F.col("_s") + F.col("cx")).withColumn("v", F.col("fy") * F.col("y") * F.col("_s") + F.col("cy")).drop("_t2", "_theta", "_r", "_s")


def rays_kb(df: DataFrame, k=("k1", "k2", "k3", "k4"), steps: int = 10) -> DataFrame:
    """Unit rays dx, dy, dz in the camera frame of pixels u, v; the angle by Newton's method."""
    out = df.withColumn("_a", (F.col("u") - F.col("cx")) / F.col("fx")).withColumn("_b", (F.col("v") - F.col("cy")) / F.col("fy"))
    out = out.withColumn("_d", F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))).withColumn("_t", F.col("_d"))
    k = [F.col(c) for c in k]
    for n in range(steps):
        t2 = F.col("_t") * F.col("_t")
        value = F.col("_t") * (1.0 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3])))) - F.col("_d")
        slope = 1.0 + t2 * (3.0 * k[0] + t2 * (5.0 * k[1] + t2 * (7.0 * k[2] + t2 * 9.0 * k[3])))
        out = out.withColumn("_t", F.col("_t") - value / slope)
    side = F.when(F.col("_d") > 1e-12, F.sin("_t") / F.when(F.col("_d") > 1e-12, F.col("_d"))).otherwise(1.0)
    return out.withColumn("dx", F.col("_a") * side).withColumn("dy", F.col("_b") * side).withColumn("dz", F.cos("_t")).drop("_a", "_b", "_d", "_t")


def rays_to_world(df: DataFrame, rotation: str = "r") -> DataFrame:
    """dx, dy, dz turned from the camera into the world by the transpose of r00..r22."""
    world = la.apply(la.transpose(la.matrix(rotation)), la.columns("dx", "dy", "dz"))
    return df.withColumns(dict(zip(("dx", "dy", "dz"), world, strict=True)))


F624 = ["f", "cu", "cv", *[f"k{i}" for i in range(6)], "p0", "p1", *[f"s{i}" for i in range(4)]]


def _f624(a, b, p, radical):
    """Pixel of the direction (a, b) = (x / z, y / z); works on Columns and on arrays."""
    r = radical["sqrt"](a * a + b * b)
    theta = radical["atan"](r)
    t2 = theta * theta
    series = 1.0
    power = 1.0
    for i in range(6):
        power = power * t2
        series = series + p[f"k{i}"] * power
    scale = radical["where"](r > 1e-9, theta / radical["where"](r > 1e-9, r, 1.0), 1.0) * series
    x, y = a * scale, b * scale
    q, xy = x * x + y * y, 2.0 * x * y
    u = x + p["p0"] * xy + p["p1"] * (q + 2.0 * x * x)
    v = y + p["p0"] * (q + 2.0 * y * y) + p["p1"] * xy
    q = u * u + v * v  # the prism's radius is that of the point already moved
    u, v = u + p["s0"] * q + p["s1"] * q * q, v + p["s2"] * q + p["s3"] * q * q
    return p["f"] * u + p["cu"], p["f"] * v + p["cv"]


def project_f624(df: DataFrame) -> DataFrame:
    """Fisheye of 15 parameters (columns of F624): u, v of camera-frame points; NULL where z is
    not in front. Six radial terms, two tangential and four of a thin prism."""
    front = F.when(F.col("z") > 1e-9, F.col("z"))
    spark_side = {"sqrt": F.sqrt, "atan": F.atan, "where": lambda c, a, b: F.when(c, a).otherwise(b)}
    out = df.withColumn("_a", F.col("x") / front).withColumn("_b", F.col("y") / front)
    u, v = _f624(F.col("_a"), F.col("_b"), {n: F.col(n) for n in F624}, spark_side)
    return out.withColumn("u", u).withColumn("v", v).drop("_a", "_b")


def rays_f624(df: DataFrame, key: list[str], most: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """key..., dx, dy, dz: unit rays in the camera frame of pixels u, v, by Gauss-Newton until a
    pixel is met to the tolerance; NULL where that fails."""
    numpy_side = {"sqrt": np.sqrt, "atan": np.arctan, "where": np.where}

    def run(parts):
        for rows in parts:
            p = {n: rows[n].to_numpy(float) for n in F624}
            u, v = rows["u"].to_numpy(float), rows["v"].to_numpy(float)
            a, b = (u - p["cu"]) / p["f"], (v - p["cv"]) / p["f"]
            h = 1e-6
            with np.errstate(all="ignore"):
                for _ in range(most):
                    gu, gv = _f624(a, b, p, numpy_side)
                    eu, ev = u - gu, v - gv
                    if np.nanmax(np.hypot(eu, ev), initial=0.0) < tolerance:
                        break
                    ua, va = _f624(a + h, b, p, numpy_side)
                    ub, vb = _f624(a, b + h, p, numpy_side)
                    j = [(ua - gu) / h, (ub - gu) / h, (va - gv) / h, (vb - gv) / h]
                    det = j[0] * j[3] - j[1] * j[2]
                    a, b = a + (j[3] * eu - j[1] * ev) / det, b + (j[0] * ev - j[2] * eu) / det
                gu, gv = _f624(a, b, p, numpy_side)
                n = np.sqrt(a * a + b * b + 1.0)
                good = np.hypot(u - gu, v - gv) < 100 * tolerance
            out = rows[key].reset_index(drop=True)
            for name, value in (("dx", a / n), ("dy", b / n), ("dz", 1.0 / n)):
                out[name] = pd.Series(np.where(good, value, np.nan)).astype(object).where(good, None)
            yield out

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)
    return df.select(*key, "u", "v", *F624).mapInPandas(run, keys + ", dx double, dy double, dz double")


def scale_intrinsics(cameras: DataFrame, sizes: DataFrame, square_only: bool = False) -> DataFrame:
    """fx, fy, cx, cy for the size (cam, w, h) at which a camera was seen; per axis, or, where the
    model has one focal length, an error for unequal scales."""
    out = cameras.join(sizes, "cam")
    sx, sy = F.col("w") / F.col("width"), F.col("h") / F.col("height")
    if square_only:
        sx = F.when(F.abs(sx - sy) > 1e-6, F.raise_error(F.lit("unequal scales"))).otherwise(sx)
    return out.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy})


def rotate_pixels(df: DataFrame, degrees: str, width: str, height: str) -> DataFrame:
    """Pixels of an image turned clockwise by 0, 90, 180 or 270 degrees, in the image's own frame
    before it was turned; width and height are those of the turned image."""
    u, v, d = F.col("u"), F.col("v"), F.col(degrees)
    w, h = F.col(width), F.col(height)
    new_u = F.when(d == 0, u).when(d == 90, v).when(d == 180, w - 1 - u).when(d == 270, h - 1 - v)
    new_v = F.when(d == 0, v).when(d == 90, w - 1 - u).when(d == 180, h - 1 - v).when(d == 270, u)
    return df.withColumn("_u", new_u).withColumn("v", new_v).withColumn("u", F.col("_u")).drop("_u")


def crop_intrinsics(boxes: DataFrame, out_size: int, pad: float = 1.1) -> DataFrame:
    """The square box around (u_min, v_min, u_max, v_max), padded, and the intrinsics inside it
    at out_size: box_u, box_v, box_size and kfx, kfy, kcx, kcy."""
    size = F.greatest(F.col("u_max") - F.col("u_min"), F.col("v_max") - F.col("v_min")) * pad
    out = boxes.withColumn("box_size", size)
    out = out.withColumn("box_u", (F.col("u_min") + F.col("u_max")) / 2.0 - F.col("box_size") / 2.0)
    out = out.withColumn("box_v", (F.col("v_min") + F.col("v_max")) / 2.0 - F.col("box_size") / 2.0)
    s = F.lit(float(out_size)) / F.col("box_size")
    return out.withColumns({"kfx": F.col("fx") * s, "kfy": F.col("fy") * s, "kcx": (F.col("cx") - F.col("box_u")) * s, "kcy": (F.col("cy") - F.col("box_v")) * s})


def pose_bbox(pose: DataFrame, diameter: float, ratio: float) -> DataFrame:
    """left, right, top, bottom of the square around a pose's projected centre that holds the
    centre moved by half the diameter times the ratio along each image axis, both ways."""
    r = diameter * ratio / 2.0
    u = lambda dx: F.col("fx") * (F.col("tx") + dx) / F.col("tz") + F.col("cx")
    v = lambda dy: F.col("fy") * (F.col("ty") + dy) / F.col("tz") + F.col("cy")
    reach = F.greatest(F.abs(u(r) - u(0.0)), F.abs(u(-r) - u(0.0)), F.abs(v(r) - v(0.0)), F.abs(v(-r) - v(0.0)))
    out = pose.withColumn("_u", u(0.0)).withColumn("_v", v(0.0)).withColumn("_r", reach)
    return out.withColumns({"left": F.col("_u") - F.col("_r"), "right": F.col("_u") + F.col("_r"), "top": F.col("_v") - F.col("_r"), "bottom": F.col("_v") + F.col("_r")}).drop("_u", "_v", "_r")


def to_camera(points: DataFrame, cameras: DataFrame, on: str = "cam") -> DataFrame:
    """World points into the camera frame, R p + t."""
    out = points.join(cameras.select(on, *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"), on)
    moved = la.plus(la.apply(la.matrix("r"), la.columns(*AXES)), la.columns("tx", "ty", "tz"))
    return out.withColumns(dict(zip(AXES, moved, strict=True))).drop(*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")


def to_world(points: DataFrame, cameras: DataFrame, on: str = "cam") -> DataFrame:
    """Camera points into the world, R' (p - t)."""
    out = points.join(cameras.select(on, *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"), on)
    moved = la.apply(la.transpose(la.matrix("r")), la.minus(la.columns(*AXES), la.columns("tx", "ty", "tz")))
    return out.withColumns(dict(zip(AXES, moved, strict=True))).drop(*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")


def body_to_camera(body: DataFrame, cameras: DataFrame) -> DataFrame:
    """A body's root orientation (rotation vector gx, gy, gz) and translation bx, by, bz in the
    camera frame. The root turns around the pelvis offset ox, oy, oz, so the translation is
    R b + t + R o - o."""
    out = body.join(cameras.select("cam", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"), "cam")
    r, o = la.matrix("r"), la.columns("ox", "oy", "oz")
    moved = la.minus(la.plus(la.plus(la.apply(r, la.columns("bx", "by", "bz")), la.columns("tx", "ty", "tz")), la.apply(r, o)), o)
    out = out.withColumns(dict(zip(("bx", "by", "bz"), moved, strict=True)))
    own = la.from_rotation_vector(la.columns("gx", "gy", "gz"))
    out = out.withColumns({f"_o{i}{j}": own[i][j] for i in range(3) for j in range(3)})
    out = la.with_rotation_vector(out, la.times(r, la.matrix("_o")), ["gx", "gy", "gz"])
    return out.drop(*[f"{p}{i}{j}" for p in ("r", "_o") for i in range(3) for j in range(3)], "tx", "ty", "tz")


ROTATIONS = {
    "vector": ["vx", "vy", "vz"],
    "quaternion": ["qw", "qx", "qy", "qz"],
    "matrix": [f"r{i}{j}" for i in range(3) for j in range(3)],
    "six": [f"c{i}" for i in range(6)],
}


def continued_turn(df: DataFrame, names: list[str], angle: Column) -> DataFrame:
    """Rotation vectors, of half a turn at most, as those of the same rotations whose lengths are nearest
    to `angle`, which may be more than half a turn."""
    v = la.columns(*names)
    size = la.norm(v)
    k = F.round((angle - size) / (2.0 * F.pi())), F.round((-angle - size) / (2.0 * F.pi()))
    off = [F.abs(F.abs(size + n * 2.0 * F.pi()) - angle) for n in k]
    turns = F.when(off[1] < off[0], k[1]).otherwise(k[0])
    scale = F.when((size > 1e-12) & (turns != 0), 1.0 + turns * 2.0 * F.pi() / size).otherwise(F.lit(1.0))
    return df.withColumn("_k", scale).withColumns({n: F.col(n) * F.col("_k") for n in names}).drop("_k")


def convert_rotation(df: DataFrame, source: str, target: str) -> DataFrame:
    """Columns of the target representation (see ROTATIONS) from those of the source."""
    names = ROTATIONS[source]
    c = la.columns(*names)
    m = {
        "vector": lambda: la.from_rotation_vector(c),
        "quaternion": lambda: la.from_quaternion(c),
        "matrix": lambda: la.matrix("r"),
        "six": lambda: la.from_six(c),
    }[source]()
    if target == "vector":
        return la.with_rotation_vector(df, m, ROTATIONS["vector"])
    made = {
        "quaternion": lambda: la.quaternion(m),
        "matrix": lambda: [m[i][j] for i in range(3) for j in range(3)],
        "six": lambda: la.to_six(m),
    }[target]()
    return df.withColumns(dict(zip(ROTATIONS[target], made, strict=True)))


def pose156to72(pose: Column) -> Column:
    """Body, root and the first joint of each hand of a 156-value pose: 72 values."""
    return F.concat(F.slice(pose, 1, 69), F.slice(pose, 115, 3))


def pose72to156(pose: Column, hands: list[float]) -> Column:
    """A 72-value pose with both hands (90 values) taken from `hands`, but for their first joints."""
    mean = F.array(*[F.lit(float(h)) for h in hands])
    return F.concat(F.slice(pose, 1, 66), F.slice(pose, 67, 3), F.slice(mean, 4, 42), F.slice(pose, 70, 3), F.slice(mean, 49, 42))


def pose_delta(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """delta rotation d00..d22 = R_b R_a' and shift dx, dy, dz = t_b - t_a; columns are prefixed."""
    turn = la.times(la.matrix(f"{b}r"), la.transpose(la.matrix(f"{a}r")))
    shift = la.minus(la.columns(*[f"{b}t{n}" for n in AXES]), la.columns(*[f"{a}t{n}" for n in AXES]))
    return df.select("*", *la.named(turn, "d"), *[s.alias(f"d{n}") for s, n in zip(shift, AXES, strict=True)])


def apply_delta(df: DataFrame, a: str = "a") -> DataFrame:
    """R = D R_a and t = t_a + d: pose_delta undone, in r00..r22 and tx, ty, tz."""
    turn = la.times(la.matrix("d"), la.matrix(f"{a}r"))
    shift = la.plus(la.columns(*[f"{a}t{n}" for n in AXES]), la.columns("dx", "dy", "dz"))
    return df.select("*", *la.named(turn, "r"), *[s.alias(f"t{n}") for s, n in zip(shift, AXES, strict=True)])


def perturb_poses(df: DataFrame, theta: float, radius: float, seed: int, *keys: str) -> DataFrame:
    """Poses turned by a random angle in [0, theta] about a random axis and shifted by a random
    length in [0, radius] along another; both follow from the row's keys."""

    def direction(start: int) -> list[Column]:
        v = [normal(start + k, *keys) for k in range(3)]
        return [c / la.norm(v) for c in v]

    turn = la.from_axis_angle(direction(seed), uniform(seed + 10, *keys) * theta)
    moved = la.times(turn, la.matrix("r"))
    length = uniform(seed + 30, *keys) * radius
    shift = [F.col(f"t{n}") + c * length for n, c in zip(AXES, direction(seed + 20), strict=True)]
    names = ROTATIONS["matrix"]
    flat = [moved[i][j] for i in range(3) for j in range(3)]
    return df.withColumns(dict(zip([*names, "tx", "ty", "tz"], [*flat, *shift], strict=True)))


def normalise_xyz(df: DataFrame, diameter: Column, reference: str = "frame", ref=("tx", "ty", "tz"), by=("seq",)) -> DataFrame:
    """x, y, z less the reference translation, that of the row or of its clip's first frame, times
    2 / diameter."""
    w = Window.partitionBy(*by).orderBy("frame")
    base = [F.col(r) if reference == "frame" else F.first(r).over(w) for r in ref]
    return df.withColumns({a: (F.col(a) - b) * 2.0 / diameter for a, b in zip(AXES, base, strict=True)})


def bbox_filter(df: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Rows inside the axis-aligned box, faces included, on all three axes."""
    keep = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        keep = keep & F.col(a).between(lo, hi)
    return df.where(keep)


def remove_background(depth: DataFrame, background: DataFrame, tolerance: float, on=("cam", "v", "u")) -> DataFrame:
    """Depth pixels that differ by the tolerance or more from the mean of the background frames at
    their place; a place without background keeps its pixels."""
    mean = background.groupBy(*on).agg(F.avg("z").alias("_b"))
    return depth.join(mean, list(on), "left").where(F.col("_b").isNull() | (F.abs(F.col("z") - F.col("_b")) >= tolerance)).drop("_b")


def gate_keypoints(df: DataFrame, threshold: float) -> DataFrame:
    """Confidence 0 where it is below the threshold."""
    return df.withColumn("conf", F.when(F.col("conf") < threshold, 0.0).otherwise(F.col("conf")))


def padded_bbox(df: DataFrame, width: int, height: int, ratio: float = 0.0, pixels: int = 0) -> DataFrame:
    """(u_min, v_min, u_max, v_max) grown on each side by the ratio of its extent and by pixels,
    within the image; the upper ends are exclusive."""
    pu = (F.col("u_max") - F.col("u_min")) * ratio + pixels
    pv = (F.col("v_max") - F.col("v_min")) * ratio + pixels
    whole = lambda c: F.round(c).cast("int")
    return df.withColumns({
        "u_min": F.greatest(whole(F.col("u_min") - pu), F.lit(0)), "v_min": F.greatest(whole(F.col("v_min") - pv), F.lit(0)),
        "u_max": F.least(whole(F.col("u_max") + pu), F.lit(width)), "v_max": F.least(whole(F.col("v_max") + pv), F.lit(height)),
    })


def in_image(df: DataFrame, width: Column, height: Column) -> DataFrame:
    return df.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def inject_depth(depth: DataFrame, masks: DataFrame, track: DataFrame, on: list[str], radius: float | None = None) -> DataFrame:
    """Depth with the pixels of the object's mask runs (v, u0, u1) set to the track's depth z_obj:
    constant, or with a radius in pixels the front of a sphere around (u_c, v_c) of that radius,
    r_m metres at that depth. before keeps the old depth; other pixels are untouched."""
    inside = masks.select(*on, "v", "u0", "u1").join(track, on)
    keyed = depth.join(inside, [*on, "v"], "left")
    covered = keyed.withColumn("_in", F.coalesce((F.col("u") >= F.col("u0")) & (F.col("u") < F.col("u1")), F.lit(False)))
    front = F.col("z_obj")
    if radius is not None:
        rho2 = F.pow(F.col("u") - F.col("u_c"), 2) + F.pow(F.col("v") - F.col("v_c"), 2)
        front = front - F.col("r_m") * F.sqrt(F.greatest(1.0 - rho2 / (radius * radius), F.lit(0.0)))
    one = covered.groupBy(*on, "v", "u", F.col("z").alias("before")).agg(F.min(F.when(F.col("_in"), front)).alias("_new"))
    return one.select(*on, "v", "u", "before", F.coalesce("_new", "before").alias("z"))


def injection_report(injected: DataFrame, by: list[str]) -> DataFrame:
    """changed pixels, and the median and largest change, of inject_depth's rows."""
    d = F.when(F.col("z") != F.col("before"), F.abs(F.col("z") - F.col("before")))
    return injected.groupBy(*by).agg(F.count(d).alias("changed"), F.median(d).alias("median_change"), F.max(d).alias("max_change"))


def augment_pixels(df: DataFrame, spec: dict, seed: int, *keys: str) -> DataFrame:
    """One augmentation of pixel rows, repeatable from the rows' keys. kinds: noise (std, most),
    drop (share of each frame's pixels, exactly its floor), ellipse and box (a shape around u, v
    with half axes a, b whose pixels go), scale (gain, offset), salt (share set to low or high)."""
    kind = spec["kind"]
    if kind == "noise":
        n = la.clip(normal(seed, *keys) * spec["std"], -spec["most"], spec["most"])
        return df.withColumn("z", F.col("z") + n)
    if kind == "drop":
        by = spec["by"]
        w = Window.partitionBy(*by)
        place = F.row_number().over(w.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys))
        return df.withColumn("_k", place).withColumn("_n", F.count("*").over(w)).where(F.col("_k") > F.floor(F.col("_n") * spec["share"])).drop("_k", "_n")
    if kind in ("ellipse", "box"):
        a, b = (F.col("u") - spec["u"]) / spec["a"], (F.col("v") - spec["v"]) / spec["b"]
        inside = a * a + b * b <= 1 if kind == "ellipse" else F.greatest(F.abs(a), F.abs(b)) <= 1
        return df.where(~inside)
    if kind == "scale":
        return df.withColumn("z", F.col("z") * spec["gain"] + spec["offset"])
    if kind == "salt":
        draw = uniform(seed, *keys)
        half = spec["share"] / 2.0
        return df.withColumn("z", F.when(draw < half, spec["low"]).when(draw < spec["share"], spec["high"]).otherwise(F.col("z")))
    raise ValueError(f"unknown augmentation {kind}")
