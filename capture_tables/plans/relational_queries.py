"""Queries of the joins."""

from pyspark.sql import functions as F

from capture_tables.operators import joins as c
from capture_tables.operators import neighbours as n
from capture_tables.operators import ranges as r
from capture_tables.plans.registry import query


@query("c1_assemble_frames", """SELECT g.seq, g.frame, R6(g.tx) AS gt_x, R6(p.tx) AS pr_x, R6(o.vis) AS vis
FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame JOIN fx_obs o ON o.seq = g.seq AND o.frame = g.frame WHERE o.tracked""")
def _(t):
    return c.assemble_frames(
        t("fx_pose_gt").select("seq", "frame", F.col("tx").alias("gt_x")),
        t("fx_pose_pr").select("seq", "frame", F.col("tx").alias("pr_x")),
        t("fx_obs").where("tracked").select("seq", "frame", "vis"),
    )


@query("c2_apply_exclusions", """WITH v AS (SELECT DISTINCT seq, cast(frame % 4 as int) AS cam FROM fx_excl)
SELECT o.seq, o.frame, o.cam, CASE WHEN x.seq IS NULL THEN 1 ELSE 0 END AS frame_mask FROM fx_obs o
LEFT JOIN fx_excl x ON x.seq = o.seq AND x.frame = o.frame LEFT JOIN v ON v.seq = o.seq AND v.cam = o.cam
WHERE NOT (v.seq IS NOT NULL AND o.seq % 10 < 8)""")
def _(t):
    excl = t("fx_excl")
    views = excl.select("seq", (F.col("frame") % 4).cast("int").alias("cam"))
    kept = c.apply_exclusions(t("fx_obs"), excl, views, F.col("seq") % 10 < 8)
    return kept.select("seq", "frame", "cam", "frame_mask")


_TIMES = """(SELECT user_id AS seq, event_id, epoch_us(ts) / 1e6 AS t_sec FROM events WHERE event_type = '{}')"""


def times(t, kind):
    stamp = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("seq"), "event_id", stamp.alias("t_sec"))


@query("c3_join_nearest", f"""WITH l AS {_TIMES.format('view')}, r AS {_TIMES.format('click')},
m AS (SELECT l.seq, l.event_id, l.t_sec, r.t_sec AS rt, r.event_id AS rid, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t_sec - l.t_sec), r.t_sec, r.event_id) AS k,
  min(r.t_sec) OVER (PARTITION BY l.event_id) AS a, max(r.t_sec) OVER (PARTITION BY l.event_id) AS b FROM l LEFT JOIN r ON l.seq = r.seq)
SELECT event_id, R6(CASE WHEN t_sec >= a - 3e3 AND t_sec <= b THEN rt END) AS near_time, CASE WHEN t_sec >= a - 3e3 AND t_sec <= b THEN rid END AS near_event_id FROM m WHERE k = 1""")
def _(t):
    found = c.join_nearest(times(t, "view"), times(t, "click"), ["seq"], "t_sec", "event_id", before=3000.0)
    return found.select("event_id", "near_time", "near_event_id")


@query("c3_join_nearest_long", f"""WITH b AS (SELECT event_id, t_sec, 1 AS side FROM {_TIMES.format('view')} l UNION ALL SELECT event_id, t_sec, 0 FROM {_TIMES.format('click')} r),
w AS (SELECT *, max(CASE WHEN side = 0 THEN {{'t': t_sec, 'v': event_id}} END) OVER (ORDER BY t_sec, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  min(CASE WHEN side = 0 THEN {{'t': t_sec, 'v': event_id}} END) OVER (ORDER BY t_sec, side, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM b),
k AS (SELECT event_id, CASE WHEN n IS NULL AND t_sec > p.t OR p IS NULL AND n.t - t_sec > 3e3 THEN NULL WHEN n IS NULL OR t_sec - p.t <= n.t - t_sec THEN p ELSE n END AS near FROM w WHERE side = 1)
SELECT event_id, R6(near.t) AS near_time, near.v AS near_event_id FROM k""")
def _(t):
    """All events as one sequence."""
    found = r.join_nearest(times(t, "view").drop("seq"), times(t, "click").drop("seq"), [], "t_sec", "event_id", before=3000.0)
    return found.select("event_id", "near_time", "near_event_id")


_FT = "(SELECT seq, cam, t, frame FROM (SELECT seq, cam, frame, frame + (event_id % 7) / 16e0 AS t FROM fx_obs) q)"


@query("c4_reference_time", f"""WITH ft AS {_FT}, grid AS (SELECT DISTINCT seq, frame AS g, frame + 25e-2 AS t FROM fx_obs WHERE frame % 10 = 0),
n1 AS (SELECT g.seq, g.g, g.t AS gt, f.cam, f.t AS ft, row_number() OVER (PARTITION BY g.seq, g.g, f.cam ORDER BY abs(f.t - g.t), f.t) AS k,
  min(f.t) OVER (PARTITION BY g.seq, g.g, f.cam) AS a, max(f.t) OVER (PARTITION BY g.seq, g.g, f.cam) AS b FROM grid g JOIN ft f ON g.seq = f.seq),
ref AS (SELECT * FROM (SELECT seq, g, cam AS ref_cam, ft AS rt, row_number() OVER (PARTITION BY seq, g ORDER BY abs(ft - gt), cam) AS p FROM n1 WHERE k = 1 AND gt >= a - 3e-1 AND gt <= b) q WHERE p = 1),
n2 AS (SELECT r.seq, r.g, r.ref_cam, r.rt, f.cam, f.t AS ft, f.frame, row_number() OVER (PARTITION BY r.seq, r.g, f.cam ORDER BY abs(f.t - r.rt), f.t) AS k,
  min(f.t) OVER (PARTITION BY r.seq, r.g, f.cam) AS a, max(f.t) OVER (PARTITION BY r.seq, r.g, f.cam) AS b FROM ref r JOIN ft f ON r.seq = f.seq)
SELECT seq, g, ref_cam, R6(rt) AS ref_time, cam, CASE WHEN rt >= a - 3e-1 AND rt <= b THEN frame END AS near_frame FROM n2 WHERE k = 1""")
def _(t):
    obs = t("fx_obs").select("seq", "cam", "frame", (F.col("frame") + (F.col("event_id") % 7) / F.lit(16.0)).alias("t"))
    grid = t("fx_obs").where("frame % 10 = 0").select("seq", F.col("frame").alias("g"), (F.col("frame") + 0.25).alias("t")).distinct()
    found = c.reference_time(grid, obs, ["seq"], "cam", "t", "frame")
    return found.select("seq", "g", "ref_cam", "ref_time", "cam", "near_frame")


@query("c5_join_offset", """SELECT a.seq, a.frame, b.frame AS other_frame, R6(a.x) AS x, R6(b.y) AS other_y FROM fx_obs a JOIN fx_obs b
ON a.seq = b.seq AND a.frame + a.seq % 3 = b.frame + 2""")
def _(t):
    a = t("fx_obs").select("seq", "frame", "x")
    b = t("fx_obs").select("seq", "frame", F.col("y").alias("other_y"))
    return c.join_offset(a, b, F.col("seq") % 3, F.lit(2))


@query("c6_dimension_lookup", """SELECT o.seq, o.frame, o.cam, R6(fx) AS fx, width FROM fx_obs o JOIN fx_cameras c ON o.cam = c.cam""")
def _(t):
    return c.with_dimension(t("fx_obs").select("seq", "frame", "cam"), t("fx_cameras").select("cam", "fx", "width"), ["cam"])


@query("c7_restrict_view", """SELECT o.seq, o.frame, o.cam FROM fx_obs o LEFT JOIN (SELECT DISTINCT seq, cast(seq % 4 as int) AS v FROM fx_excl) x ON o.seq = x.seq
WHERE o.cam = coalesce(v, 1)""")
def _(t):
    views = t("fx_excl").select("seq", (F.col("seq") % 4).cast("int").alias("cam")).distinct()
    return c.restrict_view(t("fx_obs"), views, 1).select("seq", "frame", "cam")


_SYM = """SELECT p.seq, p.frame, p.object, sym_id, """ + ", ".join(
    f"r{i}0 * s0{j} + r{i}1 * s1{j} + r{i}2 * s2{j} AS r{i}{j}" for i in range(3) for j in range(3)
) + " FROM {} p JOIN fx_symmetries s ON p.object = s.object"


@query("c8_expand_symmetries", f"SELECT seq, frame, CAST(sym_id AS INTEGER) AS sym_id, R6(r00) AS r00, R6(r12) AS r12, R6(r21) AS r21 FROM ({_SYM.format('fx_pose_gt')}) q")
def _(t):
    return c.expand_symmetries(t("fx_pose_gt"), t("fx_symmetries")).select("seq", "frame", "sym_id", "r00", "r12", "r21")


_D2 = "power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)"


@query("c9_knn_join", f"""SELECT cloud, pid, other, CAST(k AS INTEGER) AS "rank", R6(sqrt(d)) AS distance FROM (
  SELECT a.cloud, a.pid, b.pid AS other, {_D2} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS k
  FROM fx_points a JOIN fx_points b ON a.cloud = b.cloud WHERE a.side = 0 AND b.side = 1) q WHERE k <= 3""")
def _(t):
    p = t("fx_points")
    return n.knn_join(p.where("side = 0"), p.where("side = 1"), ["cloud"], "pid", "other", 3)


@query("c10_knn_interpolate", f"""SELECT cloud, pid, R6(sum(exp(-sqrt(d) / 2e-2) * val) / sum(exp(-sqrt(d) / 2e-2))) AS val FROM (
  SELECT a.cloud, a.pid, b.x + b.y AS val, {_D2} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS k
  FROM fx_points a JOIN fx_points b ON a.cloud = b.cloud WHERE a.side = 0 AND b.side = 1) q WHERE k <= 4 GROUP BY cloud, pid""")
def _(t):
    p = t("fx_points")
    known = p.where("side = 1").withColumn("val", F.col("x") + F.col("y"))
    return n.knn_interpolate(p.where("side = 0"), known, ["cloud"], "val", 4, 0.1)


@query("c11_mask_overlap", """WITH a AS (SELECT * FROM fx_runs WHERE role = 'object'), b AS (SELECT * FROM fx_runs WHERE role = 'person'),
sa AS (SELECT frame, cast(sum(u1 - u0) as bigint) AS area_a FROM a GROUP BY frame), sb AS (SELECT frame, cast(sum(u1 - u0) as bigint) AS area_b FROM b GROUP BY frame),
i AS (SELECT a.frame, cast(sum(least(a.u1, b.u1) - greatest(a.u0, b.u0)) as bigint) AS inter FROM a JOIN b ON a.frame = b.frame AND a.v = b.v AND a.u0 < b.u1 AND b.u0 < a.u1 GROUP BY a.frame)
SELECT coalesce(sa.frame, sb.frame) AS frame, coalesce(area_a, 0) AS area_a, coalesce(area_b, 0) AS area_b, coalesce(inter, 0) AS inter,
  R6(coalesce(inter, 0) / (coalesce(area_a, 0) + coalesce(area_b, 0) - coalesce(inter, 0))) AS iou
FROM sa FULL JOIN sb ON sa.frame = sb.frame LEFT JOIN i ON i.frame = coalesce(sa.frame, sb.frame)""")
def _(t):
    runs = t("fx_runs")
    return c.mask_overlap(runs.where("role = 'object'"), runs.where("role = 'person'"), ["frame"])


@query("c12_observation_combos", """WITH o AS (SELECT seq, frame // (CASE WHEN seq % 10 = 0 THEN 7 ELSE 2 END) AS grp, cam, frame, u FROM fx_rays),
p AS (SELECT a.seq, a.grp, row_number() OVER (PARTITION BY a.seq, a.grp ORDER BY a.frame, b.frame, c.frame, d.frame) - 1 AS combo, a.u AS u0, b.u AS u1, c.u AS u2, d.u AS u3
  FROM o a JOIN o b ON a.seq = b.seq AND a.grp = b.grp AND b.cam = 1 JOIN o c ON a.seq = c.seq AND a.grp = c.grp AND c.cam = 2 JOIN o d ON a.seq = d.seq AND a.grp = d.grp AND d.cam = 3 WHERE a.cam = 0)
SELECT seq, CAST(grp AS INTEGER) AS grp, CAST(combo AS INTEGER) AS combo, R6(u0) AS u0, R6(u1) AS u1, R6(u2) AS u2, R6(u3) AS u3 FROM p""")
def _(t):
    """Groups of two frames, and of seven for some sequences, which have up to 2,401 choices."""
    grp = F.floor(F.col("frame") / F.when(F.col("seq") % 10 == 0, 7).otherwise(2)).cast("int").alias("grp")
    rays = t("fx_rays").select("seq", grp, "cam", F.col("frame").alias("obs"), "u")
    whole = c.observation_choices(rays, ["seq", "grp"], ["u"]).where("cams.cam = array(0, 1, 2, 3)")
    at = lambda k: c.chosen(F.col("cams")[k], F.col("later")[k])["u"].alias(f"u{k}")
    return whole.select("seq", "grp", F.col("combo").cast("int").alias("combo"), *map(at, range(4)))


@query("c13_match_offsets", """WITH p AS (SELECT idx - 120 AS pos, cells FROM fx_thumbs WHERE idx >= 120 AND idx <= 180 AND (idx - 120) % 20 = 0),
o AS (SELECT idx AS "offset" FROM fx_thumbs)
SELECT "offset", R6(avg(list_sum(list_transform(range(1, len(p.cells) + 1), lambda i: abs(p.cells[i] - s.cells[i]))) / len(p.cells))) AS score
FROM o JOIN p ON true JOIN fx_thumbs s ON s.idx = "offset" + p.pos GROUP BY "offset" HAVING count(*) = 4""")
def _(t):
    thumbs = t("fx_thumbs")
    probes = thumbs.where("idx between 120 and 180 and (idx - 120) % 20 = 0").select((F.col("idx") - 120).alias("pos"), "cells")
    return c.match_offsets(probes, thumbs, thumbs.select(F.col("idx").alias("offset")))


@query("c14_compare_tracks", """SELECT s.seq, s.frame, R6(a.x) AS raw, R6(b.y) AS smooth FROM (SELECT seq, CAST(unnest(range(0, max(frame) + 1)) AS INTEGER) AS frame FROM fx_obs GROUP BY seq) s
LEFT JOIN (SELECT * FROM fx_obs WHERE tracked) a ON a.seq = s.seq AND a.frame = s.frame LEFT JOIN (SELECT * FROM fx_obs WHERE conf > 5e-1) b ON b.seq = s.seq AND b.frame = s.frame""")
def _(t):
    obs = t("fx_obs")
    spine = obs.groupBy("seq").agg(F.max("frame").alias("m")).select("seq", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("frame"))
    raw = obs.where("tracked").select("seq", "frame", F.col("x").alias("value"))
    smooth = obs.where("conf > 0.5").select("seq", "frame", F.col("y").alias("value"))
    return c.compare_tracks(spine, ["seq", "frame"], "value", raw=raw, smooth=smooth)


@query("c15_pairwise_distances", """SELECT a.frame, a.joint AS a, b.joint AS b, R6(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS distance
FROM fx_joints a JOIN fx_joints b ON a.frame = b.frame AND a.joint < b.joint""")
def _(t):
    return c.pairwise_distances(t("fx_joints"), ["frame"], "joint")


@query("c16_align_lengths", """WITH t AS (SELECT seq, frame, x, row_number() OVER (PARTITION BY seq ORDER BY frame) AS k, count(*) OVER (PARTITION BY seq) AS n FROM fx_obs),
p AS (SELECT seq, k, x AS pr_x FROM t WHERE k <= n - seq % 4)
SELECT t.seq, t.frame, R6(t.x) AS x, R6(last_value(p.pr_x IGNORE NULLS) OVER (PARTITION BY t.seq ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pr_x FROM t LEFT JOIN p ON t.seq = p.seq AND t.k = p.k""")
def _(t):
    from pyspark.sql import Window

    truth = t("fx_obs").select("seq", "frame", "x")
    w = Window.partitionBy("seq")
    numbered = truth.withColumn("k", F.row_number().over(w.orderBy("frame"))).withColumn("n", F.count("*").over(w))
    return c.align_lengths(truth, numbered.where("k <= n - seq % 4").select("seq", "frame", "x"), ["seq"], "frame", "x")


@query("c17_regress_landmarks", """WITH w AS (SELECT p_partkey % 5 AS landmark, p_partkey % 7 + 1 AS vertex, sum(p_size) / 100e0 AS w FROM part GROUP BY 1, 2)
SELECT frame, landmark, R6(sum(w * x)) AS x, R6(sum(w * y)) AS y, R6(sum(w * z)) AS z FROM fx_joints j JOIN w ON w.vertex = j.joint GROUP BY frame, landmark""")
def _(t):
    weights = t("part").groupBy((F.col("p_partkey") % 5).alias("landmark"), (F.col("p_partkey") % 7 + 1).alias("vertex")).agg((F.sum("p_size") / 100.0).alias("w"))
    return c.regress_landmarks(t("fx_joints").withColumnRenamed("joint", "vertex"), weights, ["frame"])
