"""Queries of triangulation, clouds and tracks."""

from pyspark.sql import functions as F

from capture_tables.operators import columns as b
from capture_tables.operators import geometry as g
from capture_tables.operators import joins as c
from capture_tables.plans.registry import query

_RAYS = """rays AS (SELECT r.seq, r.frame, r.cam, r.conf, r.u, r.v, -(c.r00 * c.tx + c.r10 * c.ty + c.r20 * c.tz) AS ox, -(c.r01 * c.tx + c.r11 * c.ty + c.r21 * c.tz) AS oy, -(c.r02 * c.tx + c.r12 * c.ty + c.r22 * c.tz) AS oz,
  c.r00 * (u - cx) / fx + c.r20 AS wx, (v - cy) / fy AS wy, c.r02 * (u - cx) / fx + c.r22 AS wz FROM fx_rays r JOIN fx_cameras c ON r.cam = c.cam),
unit AS (SELECT *, wx / sqrt(wx * wx + wy * wy + wz * wz) AS dx, wy / sqrt(wx * wx + wy * wy + wz * wz) AS dy, wz / sqrt(wx * wx + wy * wy + wz * wz) AS dz FROM rays)"""


def _solved(source, by, weight="1e0"):
    return f"""s AS (SELECT {by}, count(*) AS n_views, sum({weight} * (1 - dx * dx)) AS a00, sum({weight} * (-dx * dy)) AS a01, sum({weight} * (-dx * dz)) AS a02, sum({weight} * (1 - dy * dy)) AS a11, sum({weight} * (-dy * dz)) AS a12, sum({weight} * (1 - dz * dz)) AS a22,
  sum({weight} * ((1 - dx * dx) * ox - dx * dy * oy - dx * dz * oz)) AS b0, sum({weight} * (-dx * dy * ox + (1 - dy * dy) * oy - dy * dz * oz)) AS b1, sum({weight} * (-dx * dz * ox - dy * dz * oy + (1 - dz * dz) * oz)) AS b2 FROM {source} GROUP BY {by}),
d AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM s),
p AS (SELECT {by}, n_views, CASE WHEN abs(det) > 1e-9 THEN (b0 * (a11 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a11 * b2)) / det END AS x,
  CASE WHEN abs(det) > 1e-9 THEN (a00 * (b1 * a22 - a12 * b2) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / det END AS y,
  CASE WHEN abs(det) > 1e-9 THEN (a00 * (a11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a11 * a02)) / det END AS z FROM d)"""


def _residual(by, obs="unit"):
    on = " AND ".join(f"p.{k} = o.{k}" for k in by.split(", "))
    return f"""q AS (SELECT {', '.join('p.' + k for k in by.split(', '))}, o.u, o.v, fx, fy, cx, cy, r00 * x + r02 * z + tx AS px, y + ty AS py, r20 * x + r22 * z + tz AS pz FROM p JOIN {obs} o ON {on} JOIN fx_cameras c ON o.cam = c.cam),
res AS (SELECT {by}, avg(CASE WHEN pz > 0 THEN sqrt(power(fx * px / pz + cx - u, 2) + power(fy * py / pz + cy - v, 2)) ELSE CAST('inf' AS DOUBLE) END) AS residual FROM q GROUP BY {by})"""


@query("g2_triangulate", f"WITH {_RAYS}, {_solved('unit', 'seq, frame')}, gp AS (SELECT p.seq, p.frame, avg(sqrt(greatest(power(x - ox, 2) + power(y - oy, 2) + power(z - oz, 2) - power((x - ox) * dx + (y - oy) * dy + (z - oz) * dz, 2), 0))) AS gap FROM p JOIN unit u ON p.seq = u.seq AND p.frame = u.frame GROUP BY p.seq, p.frame) SELECT p.seq, p.frame, R6(x) AS x, R6(y) AS y, R6(z) AS z, n_views, R6(gap) AS gap FROM p JOIN gp ON p.seq = gp.seq AND p.frame = gp.frame")
def _(t):
    return g.triangulate(g.camera_rays(t("fx_rays").select("seq", "frame", "cam", "u", "v"), t("fx_cameras")), ["seq", "frame"])


@query("g3_triangulate_joints", f"""WITH {_RAYS}, j AS (SELECT * FROM (SELECT *, frame // 2 AS grp, row_number() OVER (PARTITION BY seq, frame // 2, cam ORDER BY frame) AS k FROM unit WHERE conf >= 3e-1) q WHERE k = 1),
m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY seq, grp) AS n FROM j) q WHERE n >= 2), {_solved('m', 'seq, grp', 'conf')}, {_residual('seq, grp', 'm')}
SELECT p.seq, p.grp, R6(x) AS x, R6(y) AS y, R6(z) AS z, R6(residual) AS residual, coalesce(residual <= 3e-1, false) AS "valid" FROM p LEFT JOIN res ON p.seq = res.seq AND p.grp = res.grp""")
def _(t):
    kps = t("fx_rays").withColumn("grp", F.floor(F.col("frame") / 2).cast("int"))
    found = g.triangulate_joints(kps, t("fx_cameras"), ["seq", "grp"], "frame", 0.3, 0.3)
    return found.select("seq", "grp", "x", "y", "z", "residual", "valid")


@query("g4_reprojection_residual", f"WITH {_RAYS}, {_solved('unit', 'seq, frame')}, {_residual('seq, frame')} SELECT seq, frame, R6(residual) AS residual FROM res")
def _(t):
    obs, cams = t("fx_rays").select("seq", "frame", "cam", "u", "v"), t("fx_cameras")
    points = g.triangulate(g.camera_rays(obs, cams), ["seq", "frame"])
    return g.reprojection_residual(points, obs, cams, ["seq", "frame"], 1024.0)


_PICK = "o2 AS (SELECT * FROM (SELECT *, frame // 3 AS grp, row_number() OVER (PARTITION BY seq, frame // 3, cam ORDER BY frame) - 1 AS k FROM unit WHERE cam < 2) q WHERE k < 2)"


@query("g5_triangulate_best", f"""WITH {_RAYS}, {_PICK}, n AS (SELECT seq, grp, cam, count(*) AS n FROM o2 GROUP BY seq, grp, cam),
cb AS (SELECT a.seq, a.grp, a.k * n.n + b.k AS combo, a.frame AS f0, b.frame AS f1 FROM o2 a JOIN o2 b ON a.seq = b.seq AND a.grp = b.grp AND b.cam = 1 JOIN n ON n.seq = a.seq AND n.grp = a.grp AND n.cam = 1 WHERE a.cam = 0),
ob AS (SELECT cb.seq, cb.grp, combo, o.cam, o.u, o.v, ox, oy, oz, dx, dy, dz FROM cb JOIN o2 o ON o.seq = cb.seq AND o.grp = cb.grp AND ((o.cam = 0 AND o.frame = f0) OR (o.cam = 1 AND o.frame = f1))),
{_solved('ob', 'seq, grp, combo')}, {_residual('seq, grp, combo', 'ob')}, rk AS (SELECT p.*, residual, row_number() OVER (PARTITION BY p.seq, p.grp ORDER BY round(residual, 9), p.combo) AS k FROM p JOIN res ON p.seq = res.seq AND p.grp = res.grp AND p.combo = res.combo WHERE x IS NOT NULL)
SELECT seq, grp, CAST(combo AS INTEGER) AS combo, R6(x) AS x, R6(y) AS y, R6(z) AS z, R6(residual) AS residual FROM rk WHERE k = 1""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("seq", "grp", "cam").orderBy("frame")
    obs = t("fx_rays").where("cam < 2").withColumn("grp", F.floor(F.col("frame") / 3).cast("int")).withColumn("k", F.row_number().over(w)).where("k <= 2")
    combos = c.observation_combos(obs.select("seq", "grp", "cam", F.col("frame").alias("obs"), "u", "v"), ["seq", "grp"], ["u", "v"])
    best = g.triangulate_best(combos, t("fx_cameras"), ["seq", "grp"])
    return best.where("n_views = 2").select("seq", "grp", F.col("combo").cast("int").alias("combo"), "x", "y", "z", "residual")


@query("g5_triangulate_frames", f"""WITH {_RAYS}, o2 AS (SELECT *, frame // 3 AS grp, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY seq, frame // 3, cam) AS n FROM unit WINDOW w AS (PARTITION BY seq, frame // 3, cam ORDER BY frame)),
cb AS (SELECT a.seq, a.grp, ((a.k * b.n + b.k) * c.n + c.k) * d.n + d.k AS combo, [a.frame, b.frame, c.frame, d.frame] AS f FROM o2 a JOIN o2 b ON a.seq = b.seq AND a.grp = b.grp JOIN o2 c ON a.seq = c.seq AND a.grp = c.grp JOIN o2 d ON a.seq = d.seq AND a.grp = d.grp WHERE a.cam = 0 AND b.cam = 1 AND c.cam = 2 AND d.cam = 3),
ob AS (SELECT cb.seq, cb.grp, combo, o.cam, o.u, o.v, ox, oy, oz, dx, dy, dz FROM cb JOIN o2 o ON o.seq = cb.seq AND o.grp = cb.grp AND o.frame = cb.f[o.cam + 1]),
{_solved('ob', 'seq, grp, combo')}, {_residual('seq, grp, combo', 'ob')}, rk AS (SELECT p.*, residual, row_number() OVER (PARTITION BY p.seq, p.grp ORDER BY round(residual, 9), p.combo) AS k FROM p JOIN res ON p.seq = res.seq AND p.grp = res.grp AND p.combo = res.combo WHERE x IS NOT NULL)
SELECT seq, grp, CAST(combo AS INTEGER) AS combo, R6(x) AS x, R6(y) AS y, R6(z) AS z, R6(residual) AS residual FROM rk WHERE k = 1""")
def _(t):
    """All observations of all cameras in three frames; groups that four cameras see."""
    obs = t("fx_rays").select("seq", F.floor(F.col("frame") / 3).cast("int").alias("grp"), "cam", F.col("frame").alias("obs"), "u", "v")
    best = g.triangulate_frames(obs, t("fx_cameras"), ["seq", "grp"])
    return best.where("n_views = 4").select("seq", "grp", F.col("combo").cast("int").alias("combo"), "x", "y", "z", "residual")


@query("g6_triangulate_clicks", f"""WITH {_RAYS}, c0 AS (SELECT concat('p', cast(seq as varchar(9))) AS point, * FROM unit WHERE frame = 0), {_solved('c0', 'point')}, {_residual('point', 'c0')}
SELECT p.point, R6(x) AS x, R6(y) AS y, R6(z) AS z, n_views, R6(residual) AS residual, residual > 2e-1 AS flagged FROM p JOIN res ON p.point = res.point""")
def _(t):
    clicks = t("fx_rays").where("frame = 0").select(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("point"), "cam", "u", "v")
    return g.triangulate_clicks(clicks, t("fx_cameras"), 0.2)


@query("g7_coverage_report", """WITH s AS (SELECT *, 2 + event_id % 3 AS n_views, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS s FROM fx_obs WINDOW w AS (PARTITION BY seq ORDER BY frame))
SELECT seq, count(*) AS frames, CAST(sum(CASE WHEN n_views = 2 THEN 1 ELSE 0 END) AS BIGINT) AS two_views, CAST(sum(CASE WHEN n_views > 2 THEN 1 ELSE 0 END) AS BIGINT) AS more_views, R6(avg(CASE WHEN vis <= 5e-1 THEN 1e0 ELSE 0e0 END) * 100) AS within,
  R6(median(vis)) AS median_residual, R6(quantile_cont(vis, 9e-1)) AS p90_residual, R6(median(s)) AS median_step, R6(max(s)) AS max_step, min(struct_pack(z := z, f := frame)).f AS lowest_frame, max(struct_pack(z := z, f := frame)).f AS highest_frame FROM s GROUP BY seq""")
def _(t):
    track = t("fx_obs").withColumn("n_views", 2 + F.col("event_id") % 3).withColumn("residual", F.col("vis"))
    return g.coverage_report(track, ["seq"], 0.5)


@query("g8_compare_camera_models", """WITH a AS (SELECT seq, frame, o.cam, x, y, z, fx, fy, cx, cy, fx * x / z + cx + event_id % 5 AS cu, fy * y / z + cy - event_id % 3 AS cv, sqrt(x * x + y * y) AS r FROM fx_obs o JOIN fx_cameras c ON o.cam = c.cam),
e AS (SELECT cam, sqrt(power(fx * x / z + cx - cu, 2) + power(fy * y / z + cy - cv, 2)) AS pe, sqrt(power(fx * x * atan2(r, z) / r + cx - cu, 2) + power(fy * y * atan2(r, z) / r + cy - cv, 2)) AS fe, z / fx AS m FROM a)
SELECT cam, R6(median(pe)) AS pinhole_error, R6(median(fe)) AS fisheye_error, R6(median(m)) AS metres_per_pixel, CASE WHEN median(pe) <= median(fe) THEN 'pinhole' ELSE 'fisheye' END AS better FROM e GROUP BY cam""")
def _(t):
    cams = t("fx_cameras").select("cam", "fx", "fy", "cx", "cy")
    obs, keys = t("fx_obs"), ["seq", "frame"]
    pinhole = b.project_pinhole(obs, cams)
    lens = obs.join(cams, "cam").withColumns({k: F.lit(0.0) for k in ("k1", "k2", "k3", "k4")})
    seen = pinhole.withColumn("u", F.col("u") + F.col("event_id") % 5).withColumn("v", F.col("v") - F.col("event_id") % 3)
    return g.compare_camera_models(obs.join(cams, "cam"), seen, pinhole, b.project_kb(lens), keys)


@query("g9_validate_reprojection", """WITH e AS (SELECT r.cam, sqrt(power(fx * px / pz + cx - r.u, 2) + power(fy * py / pz + cy - r.v, 2)) AS e, sqrt(power(r.u - 512, 2) + power(r.v - 384, 2)) AS d FROM fx_rays r JOIN fx_seen s ON r.seq = s.seq AND r.frame = s.frame AND r.cam = s.cam)
SELECT cam, count(*) AS n, R6(median(e)) AS median, R6(avg(e)) AS mean, R6(max(e)) AS worst, R6(corr(d, e)) AS corr, median(e) < 15 AS passed FROM e GROUP BY cam""")
def _(t):
    seen = t("fx_seen").where("pz > 1e-6").select("seq", "frame", "cam", (F.col("fx") * F.col("px") / F.col("pz") + F.col("cx")).alias("u"), (F.col("fy") * F.col("py") / F.col("pz") + F.col("cy")).alias("v"))
    return g.validate_reprojection(seen, t("fx_rays"), ["seq", "frame", "cam"], ["cam"], (512.0, 384.0))


@query("g24_voxel_downsample", "SELECT cloud, R6(avg(x)) AS x, R6(avg(y)) AS y, R6(avg(z)) AS z, count(*) AS n FROM fx_points GROUP BY cloud, floor(x / 1e-1), floor(y / 1e-1), floor(z / 1e-1)")
def _(t):
    return g.voxel_downsample(t("fx_points"), 0.1, ["cloud"])


@query("g25_contact_distances", """WITH o AS (SELECT seq AS s, frame % 7 AS f, event_id AS pid, x / 5 AS x, y, z FROM fx_obs), j AS (SELECT seq, frame, joint, x, y, z FROM fx_joints),
m AS (SELECT j.seq, j.frame, joint, min(power(j.x - o.x, 2) + power(j.y - o.y, 2) + power(j.z - o.z, 2)) AS d FROM j JOIN o ON o.s = j.seq GROUP BY j.seq, j.frame, joint) SELECT seq, frame, joint, R6(d) AS distance FROM m""")
def _(t):
    objects = t("fx_obs").select("seq", F.col("event_id").alias("pid"), (F.col("x") / 5).alias("x"), "y", "z")
    joints = t("fx_joints").withColumn("key", F.struct("frame", "joint"))
    return g.contact_distances(joints, objects, ["seq"], "key").select("seq", "key.frame", "key.joint", "distance")


@query("g25_surface_distance", """WITH a AS (SELECT seq, frame, x AS px, z AS pz FROM fx_obs) SELECT seq, frame, R6(sqrt(power(greatest(px - 1, 0), 2) + power(pz, 2))) AS distance FROM a""")
def _(t):
    """From points of the x axis's plane to a long thin triangle along it: the foot lies on it or at its end."""
    tri = {"ax": 0.0, "ay": 0.0, "az": 0.0, "bx": 1.0, "by": 0.0, "bz": 0.0, "cx": 0.0, "cy": -1.0, "cz": 0.0}
    points = t("fx_obs").select("seq", "frame", F.col("x").alias("px"), F.lit(0.0).alias("py"), F.col("z").alias("pz")).withColumns({k: F.lit(v) for k, v in tri.items()})
    return g.point_triangle_distance(points).select("seq", "frame", "distance")


def _faces(t):
    from pyspark.sql import Window

    w = Window.partitionBy("cloud").orderBy("pid")
    p = t("fx_points")
    out = p
    for k, v in enumerate("abc"):
        out = out.withColumns({f"{v}{a}": F.lead(a, k).over(w) for a in "xyz"})
    return out.where("cx is not null").select("cloud", F.col("pid").alias("face"), *[f"{v}{a}" for v in "abc" for a in "xyz"])


@query("g26_sample_surface")
def _(t):
    return g.sample_surface(_faces(t), 200, 9, ["cloud"], "face")


@query("g27_cloud_diameter", "SELECT a.cloud, R6(max(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)))) AS diameter FROM fx_points a JOIN fx_points b ON a.cloud = b.cloud AND a.pid <= b.pid GROUP BY a.cloud")
def _(t):
    return g.cloud_diameter(t("fx_points"), ["cloud"])


@query("g28_is_flipped")
def _(t):
    p = t("fx_points")
    return g.is_flipped(p.where("side = 0"), p.where("side = 1"), ["cloud"])


@query("g29_symmetry_table", """WITH i AS (SELECT cast(r_regionkey as int) AS object, unnest(CASE WHEN r_regionkey % 2 = 0 THEN range(0, 360, 5) ELSE range(0, 1) END) AS a FROM region)
SELECT object, cast(a // 5 as int) AS sym_id, R6(cos(radians(a))) AS s00, R6(-sin(radians(a))) AS s01, R6(sin(radians(a))) AS s10, R6(1e0) AS s22 FROM i""")
def _(t):
    info = t("region").select(F.col("r_regionkey").cast("int").alias("object"), *[F.when(F.col("r_regionkey") % 2 == 0, F.lit(v)).alias(f"a{n}") for n, v in (("x", 0.0), ("y", 0.0), ("z", 1.0))])
    return g.symmetry_table(info).select("object", "sym_id", "s00", "s01", "s10", "s22")


@query("g30_cluster_poses")
def _(t):
    """Each sequence's poses by chunks of 32 frames as hypotheses, clustered in order of visibility."""
    hyp = t("fx_pose_gt").join(t("fx_obs").select("seq", "frame", "vis"), ["seq", "frame"]).withColumn("chunk", F.floor(F.col("frame") / 32).cast("int"))
    return g.cluster_poses(hyp, t("fx_symmetries"), ["seq", "chunk"], "vis", "frame", 0.3, 0.5)


@query("g32_pick_scale", """WITH c AS (SELECT cloud, k, 5e-1 + k * 25e-2 AS scale FROM (SELECT DISTINCT cloud FROM fx_points) a, (SELECT unnest(range(0, 7)) AS k) r),
m AS (SELECT cloud, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM fx_points WHERE side = 0 GROUP BY cloud),
s AS (SELECT p.cloud, k, scale, pid, cx + (x - cx) * scale AS x, cy + (y - cy) * scale AS y, cz + (z - cz) * scale AS z FROM fx_points p JOIN m ON p.cloud = m.cloud JOIN c ON c.cloud = p.cloud WHERE side = 0),
n AS (SELECT s.cloud, k, scale, s.pid, min(sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2) + power(s.z - t.z, 2))) AS d FROM s JOIN fx_points t ON t.cloud = s.cloud AND t.side = 1 GROUP BY s.cloud, k, scale, s.pid)
SELECT cloud, cast(k as int) AS k, R6(scale) AS scale, R6(avg(d)) AS score FROM n GROUP BY cloud, k, scale""")
def _(t):
    p = t("fx_points")
    ranges = p.select("cloud").distinct().withColumns({"lo": F.lit(0.5), "hi": F.lit(2.0)})
    found = g.pick_scale(g.scale_candidates(ranges, 7, ["cloud"]), p.where("side = 0"), p.where("side = 1"), ["cloud"])
    return found.select("cloud", "k", "scale", "score")


@query("g33_floor_check", """WITH l AS (SELECT seq, frame, min(z) AS z FROM fx_joints WHERE joint IN (1, 2, 5, 6) GROUP BY seq, frame), f AS (SELECT seq, quantile_cont(z, 1e-1) AS fl FROM l GROUP BY seq), o AS (SELECT seq, min(z) AS ob FROM fx_joints WHERE joint = 3 GROUP BY seq)
SELECT f.seq, R6(fl) AS floor, R6(fl - ob) AS gap, abs(round(fl - ob, 9)) < 6e-2 AS agrees FROM f JOIN o ON f.seq = o.seq""")
def _(t):
    joints = t("fx_joints")
    ball = joints.where("joint = 3").groupBy("seq").agg(F.min("z").alias("object_floor"))
    return g.floor_check(joints, [1, 2, 5, 6], ball, ["seq"])


@query("g34_hand_object_gap", """WITH w AS (SELECT seq, frame, min(sqrt(x * x + y * y + z * z)) AS d FROM fx_joints WHERE joint IN (4, 7) GROUP BY seq, frame), o AS (SELECT seq, frame, sqrt(x * x + y * y + z * z) AS d FROM fx_joints WHERE joint = 1)
SELECT w.seq, R6(median(w.d - o.d)) AS median, R6(avg(w.d - o.d)) AS mean, R6(stddev_pop(w.d - o.d)) AS std FROM w JOIN o ON w.seq = o.seq AND w.frame = o.frame GROUP BY w.seq""")
def _(t):
    joints = t("fx_joints").withColumn("dist", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return g.hand_object_gap(joints.where("joint in (4, 7)"), joints.where("joint = 1"), ["seq"], 0, 1 << 30)


@query("g35_ray_error_split", """WITH a AS (SELECT g.seq, g.frame, p.tx - g.tx AS ex, p.ty - g.ty AS ey, p.tz - g.tz AS ez, g.tx - 1e-1 AS rx, g.ty - 2e-1 AS ry, g.tz + 1 AS rz FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame),
b AS (SELECT *, (ex * rx + ey * ry + ez * rz) / sqrt(rx * rx + ry * ry + rz * rz) AS along FROM a) SELECT seq, frame, R6(along) AS along, R6(sqrt(greatest(ex * ex + ey * ey + ez * ez - along * along, 0))) AS across FROM b""")
def _(t):
    xyz = lambda df: df.select("seq", "frame", *[F.col(f"t{a}").alias(a) for a in "xyz"])
    return g.ray_error_split(xyz(t("fx_pose_pr")), xyz(t("fx_pose_gt")), ["seq", "frame"], (0.1, 0.2, -1.0))


@query("g36_stage_drop", "SELECT seq, cam, R6(min(z)) AS min_z, min(struct_pack(z := z, f := frame)).f AS min_frame, R6(arg_min(z, frame) - min(z)) AS drop FROM fx_obs GROUP BY seq, cam")
def _(t):
    return g.stage_drop(t("fx_obs"), ["seq", "cam"])


@query("g37_mean_shape", """WITH b AS (SELECT idx, idx % 10 AS seq, list_slice(cells, 1, 10) AS l FROM fx_thumbs), m AS (SELECT seq, i, avg(l[i]) AS m FROM b, (SELECT unnest(range(1, 11)) AS i) r GROUP BY seq, i)
SELECT idx, R6(sum(m * i)) AS weighted FROM b JOIN m ON b.seq = m.seq GROUP BY idx""")
def _(t):
    human = t("fx_thumbs").select("idx", (F.col("idx") % 10).alias("seq"), F.slice("cells", 1, 10).alias("betas"))
    weighted = F.aggregate(F.transform("mean_betas", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return g.mean_shape(human, ["seq"]).select("idx", weighted.alias("weighted"))


@query("g38_pose_prior_score", """WITH d AS (SELECT idx, i - 1 AS dim, cells[i] AS v FROM fx_thumbs, (SELECT unnest(range(1, 65)) AS i) r), m AS (SELECT dim, avg(v) AS m FROM d GROUP BY dim), o AS (SELECT unnest(range(0, 8)) AS o),
p AS (SELECT idx, o, sum((v - m) * (((d.dim * 7 + o * 3) % 11 - 5) / 10e0)) AS p FROM d JOIN m ON d.dim = m.dim, o GROUP BY idx, o) SELECT idx, R6(sum(p * p)) AS score FROM p GROUP BY idx""")
def _(t):
    poses = t("fx_thumbs").select("idx", F.col("cells").alias("pose"))
    dims = poses.select(F.posexplode("pose").alias("dim", "v"))
    mean = dims.groupBy("dim").agg(F.avg("v").alias("m"))
    out = F.explode(F.sequence(F.lit(0), F.lit(7)))
    factor = mean.select("dim", out.alias("out")).select("dim", "out", (((F.col("dim") * 7 + F.col("out") * 3) % 11 - 5) / 10.0).alias("w"))
    return g.pose_prior_score(poses, mean, factor, ["idx"])


@query("g40_fuse_views", """WITH i AS (SELECT d.frame, d.v, d.u, d.z, bool_or(coalesce(d.u >= m.u0 AND d.u < m.u1, false)) AS inside FROM fx_depth d LEFT JOIN (SELECT * FROM fx_runs WHERE role = 'object') m ON d.frame = m.frame AND d.v = m.v GROUP BY d.frame, d.v, d.u, d.z),
k AS (SELECT *, bool_or(inside) OVER (PARTITION BY frame) AS any_in FROM i), l AS (SELECT frame, c.*, (u - cx) * z / fx - tx AS a, (v - cy) * z / fy - ty AS b, z - tz AS d FROM k JOIN fx_cameras c ON c.cam = k.frame % 4 WHERE inside OR NOT any_in)
SELECT frame, cam, R6(r00 * a + r20 * d) AS x, R6(b) AS y, R6(r02 * a + r22 * d) AS z FROM l""")
def _(t):
    depth = t("fx_depth").withColumn("cam", (F.col("frame") % 4).cast("int"))
    return g.fuse_views(depth, t("fx_runs").where("role = 'object'"), t("fx_cameras"), ["frame"])


@query("g23_register_z")
def _(t):
    p = t("fx_points")
    moved = p.where("side = 0").withColumn("z", F.col("z") + 2.0)
    return g.register_z(moved, p.where("side = 1").withColumn("z", F.col("z") + 2.2), ["cloud"])
