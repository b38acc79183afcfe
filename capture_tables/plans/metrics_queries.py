"""Queries of the error metrics, the flagship among them."""

from pyspark.sql import functions as F

from capture_tables.operators import metrics as d
from capture_tables.plans.registry import query

_R = [f"r{i}{j}" for i in range(3) for j in range(3)]
_GT_SYM = "SELECT p.seq, p.frame, p.object, p.tx, p.ty, p.tz, " + ", ".join(
    f"p.r{i}0 * s0{j} + p.r{i}1 * s1{j} + p.r{i}2 * s2{j} AS {'r'}{i}{j}" for i in range(3) for j in range(3)
) + " FROM fx_pose_gt p JOIN fx_symmetries s ON p.object = s.object"
_TRACE = " + ".join(f"p.{r} * g.{r}" for r in _R)
_ERR = f"""err AS (SELECT g.seq, g.frame, g.object, min(acos(greatest(least(round(({_TRACE} - 1) / 2, 12), 1e0), -1e0))) AS rot_error,
  min(sqrt(power(p.tx - g.tx, 2) + power(p.ty - g.ty, 2) + power(p.tz - g.tz, 2))) AS trans_error
  FROM g JOIN fx_pose_pr p ON p.seq = g.seq AND p.frame = g.frame GROUP BY g.seq, g.frame, g.object)"""


def _errors(t):
    return d.pose_error(t("fx_pose_pr"), t("fx_pose_gt"), t("fx_symmetries"))


@query("d20_pose_error_summary", f"""WITH g AS ({_GT_SYM}), {_ERR} SELECT object, seq, R6(avg(degrees(rot_error))) AS rot_error, R6(avg(trans_error)) AS trans_error,
  count(*) AS frames, count(DISTINCT seq) AS seqs FROM err GROUP BY ROLLUP (object, seq)""")
def _(t):
    return d.summarise(_errors(t), ["rot_error", "trans_error"], by=["object", "seq"])


@query("d1_rotation_error", f"WITH g AS ({_GT_SYM}), {_ERR} SELECT seq, frame, R6(rot_error) AS rot_error FROM err")
def _(t):
    return _errors(t).select("seq", "frame", "rot_error")


@query("d2_translation_error", f"WITH g AS ({_GT_SYM}), {_ERR} SELECT seq, frame, R6(trans_error) AS trans_error FROM err")
def _(t):
    return _errors(t).select("seq", "frame", "trans_error")


_JJ = "fx_joints g JOIN fx_joints_pr p ON g.seq = p.seq AND g.frame = p.frame AND g.joint = p.joint"


@query("d3_mpjpe", f"""WITH m AS (SELECT g.seq, g.frame, g.joint, p.x - g.x AS dx, p.y - g.y AS dy, p.z - g.z AS dz FROM {_JJ} WHERE g.joint BETWEEN 1 AND 5),
r AS (SELECT seq, frame, dx AS rx, dy AS ry, dz AS rz FROM m WHERE joint = 1)
SELECT m.seq, m.frame, R6(avg(sqrt(power(dx - rx, 2) + power(dy - ry, 2) + power(dz - rz, 2)))) AS mpjpe FROM m LEFT JOIN r ON m.seq = r.seq AND m.frame = r.frame GROUP BY m.seq, m.frame""")
def _(t):
    return d.mpjpe(t("fx_joints_pr"), t("fx_joints"), 5, 1)


@query("d4_v2v", f"SELECT g.seq, g.frame, R6(avg(sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2) + power(p.z - g.z, 2)))) AS v2v FROM {_JJ} GROUP BY g.seq, g.frame")
def _(t):
    return d.v2v(t("fx_joints_pr"), t("fx_joints"), "joint")


@query("d5_mpjae", f"""SELECT g.seq, cast(floor(g.frame / 4) as bigint) AS frame, R6(avg(acos(greatest(least(round(({_TRACE} - 1) / 2, 12), 1e0), -1e0)))) AS mpjae
FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame GROUP BY 1, 2""")
def _(t):
    four = lambda df: df.withColumn("joint", F.col("frame") % 4).withColumn("frame", F.floor(F.col("frame") / 4))
    return d.mpjae(four(t("fx_pose_pr")), four(t("fx_pose_gt")))


@query("d6_root_error", """SELECT g.seq, g.frame, R6(sqrt(power(p.tx - g.tx, 2) + power(p.ty - g.ty, 2) + power(p.tz - g.tz, 2))) AS root_error
FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame""")
def _(t):
    return d.root_error(t("fx_pose_pr"), t("fx_pose_gt"))


@query("d7_acceleration_error", """WITH a AS (SELECT seq, frame, sqrt(power((lag(x) OVER w - 2 * x + lead(x) OVER w) - (lag(z) OVER w - 2 * z + lead(z) OVER w), 2)
  + power((lag(y) OVER w - 2 * y + lead(y) OVER w) - (lag(conf) OVER w - 2 * conf + lead(conf) OVER w), 2)) AS e FROM fx_obs WINDOW w AS (PARTITION BY seq ORDER BY frame))
SELECT seq, frame, R6(coalesce(e, lead(e) OVER w, lag(e) OVER w)) AS acc_error FROM a WINDOW w AS (PARTITION BY seq ORDER BY frame)""")
def _(t):
    return d.acceleration_error(t("fx_obs"), ["x", "y"], ["z", "conf"]).select("seq", "frame", "acc_error")


@query("d8_jitter", """WITH a AS (SELECT seq, frame, sqrt(power(lead(x) OVER w - 3 * x + 3 * lag(x) OVER w - lag(x, 2) OVER w, 2) + power(lead(y) OVER w - 3 * y + 3 * lag(y) OVER w - lag(y, 2) OVER w, 2)) AS e
  FROM fx_obs WINDOW w AS (PARTITION BY seq ORDER BY frame))
SELECT seq, frame, R6(coalesce(e, lead(e) OVER w, lead(e, 2) OVER w, lag(e) OVER w)) AS jitter FROM a WINDOW w AS (PARTITION BY seq ORDER BY frame)""")
def _(t):
    return d.jitter(t("fx_obs"), ["x", "y"]).select("seq", "frame", "jitter")


_NN = """nn AS (SELECT a.cloud, a.side, a.pid, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d
  FROM pts a JOIN pts b ON a.cloud = b.cloud AND a.side <> b.side GROUP BY a.cloud, a.side, a.pid)"""
_PTS = "pts AS (SELECT * FROM fx_points)"


def _sides(t):
    p = t("fx_points")
    return p.where("side = 0"), p.where("side = 1")


@query("d9_chamfer", f"""WITH {_PTS}, {_NN} SELECT cloud, R6(avg(CASE WHEN side = 0 THEN d END)) AS gt_to_pr, R6(avg(CASE WHEN side = 1 THEN d END)) AS pr_to_gt,
  R6(avg(CASE WHEN side = 0 THEN d END) + avg(CASE WHEN side = 1 THEN d END)) AS chamfer FROM nn GROUP BY cloud""")
def _(t):
    return d.chamfer(*_sides(t), ["cloud"])


@query("d10_fscore", f"""WITH {_PTS}, {_NN}, s AS (SELECT cloud, avg(CASE WHEN side = 0 THEN CASE WHEN d < 1e-1 THEN 1e0 ELSE 0e0 END END) AS a, avg(CASE WHEN side = 1 THEN CASE WHEN d < 1e-1 THEN 1e0 ELSE 0e0 END END) AS b FROM nn GROUP BY cloud)
SELECT cloud, R6(a) AS share_gt, R6(b) AS share_pr, R6(CASE WHEN a + b = 0 THEN 0e0 ELSE 2 * a * b / (a + b) END) AS fscore FROM s""")
def _(t):
    return d.fscore(*_sides(t), ["cloud"], 0.1)


_NORM = """c AS (SELECT cloud, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_points WHERE side = 0 GROUP BY cloud),
s AS (SELECT c.cloud, mx, my, mz, 2 * max(sqrt(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2))) AS s FROM fx_points p JOIN c ON p.cloud = c.cloud WHERE side = 0 GROUP BY c.cloud, mx, my, mz),
pts AS (SELECT p.cloud, side, pid, (x - mx) / s AS x, (y - my) / s AS y, (z - mz) / s AS z FROM fx_points p JOIN s ON p.cloud = s.cloud)"""


@query("d11_normalise_clouds", f"WITH {_NORM} SELECT cloud, side, pid, R6(x) AS x, R6(y) AS y, R6(z) AS z FROM pts")
def _(t):
    gt, pr = d.normalise_clouds(*_sides(t), ["cloud"])
    return gt.unionByName(pr)


@query("d12_align_first_frame")
def _(t):
    """Each sequence's joints under the similarity that fits its first frame of three joints."""
    full = t("fx_joints").groupBy("seq", "frame").agg(F.count("*").alias("n")).where("n >= 4").select("seq", "frame")
    gt = t("fx_joints").join(full, ["seq", "frame"])
    pr = t("fx_joints_pr").join(full, ["seq", "frame"])
    return d.align_first_frame(pr, gt).select("seq", "frame", "joint", "x", "y", "z")


@query("d13_pa_error")
def _(t):
    full = t("fx_joints").groupBy("seq", "frame").agg(F.count("*").alias("n")).where("n >= 4").select("seq", "frame")
    return d.pa_error(t("fx_joints_pr").join(full, ["seq", "frame"]), t("fx_joints"))


_MODEL = """model AS (SELECT cast(s_suppkey % 5 as int) AS object, s_suppkey AS pid, (s_nationkey % 7 - 3) / 10e0 AS mx, (s_suppkey % 11 - 5) / 20e0 AS my, (s_nationkey % 5 - 2) / 10e0 AS mz FROM supplier)"""


def _model(t):
    return t("supplier").select(
        (F.col("s_suppkey") % 5).cast("int").alias("object"), F.col("s_suppkey").alias("pid"), ((F.col("s_nationkey") % 7 - 3) / 10.0).alias("mx"),
        ((F.col("s_suppkey") % 11 - 5) / 20.0).alias("my"), ((F.col("s_nationkey") % 5 - 2) / 10.0).alias("mz"))


def _moved(table):
    return f"SELECT p.seq, p.frame, m.pid, " + ", ".join(f"r{i}0 * mx + r{i}1 * my + r{i}2 * mz + t{a} AS {a}" for i, a in enumerate("xyz")) + f" FROM {table} p JOIN model m ON p.object = m.object"


@query("d14_add_error", f"""WITH {_MODEL}, a AS ({_moved('fx_pose_gt')}), b AS ({_moved('fx_pose_pr')})
SELECT a.seq, a.frame, R6(avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)))) AS "add" FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.pid = b.pid GROUP BY a.seq, a.frame""")
def _(t):
    return d.add_error(t("fx_pose_pr"), t("fx_pose_gt"), _model(t))


@query("d15_adds_error", f"""WITH {_MODEL}, a AS ({_moved('fx_pose_gt')}), b AS ({_moved('fx_pose_pr')}),
n AS (SELECT a.seq, a.frame, a.pid, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame GROUP BY a.seq, a.frame, a.pid)
SELECT seq, frame, R6(avg(d)) AS adds FROM n GROUP BY seq, frame""")
def _(t):
    return d.adds_error(t("fx_pose_pr"), t("fx_pose_gt"), _model(t))


@query("d16_accuracy_auc", """WITH k AS (SELECT unnest(range(0, 101)) AS k), a AS (SELECT o.seq, k.k, avg(CASE WHEN (o.x % 15e-2) <= k.k * 1e-3 + 1e-12 THEN 1e0 ELSE 0e0 END) AS acc FROM fx_obs o JOIN k ON true GROUP BY o.seq, k.k)
SELECT seq, R6(sum(CASE WHEN k IN (0, 100) THEN acc / 2 ELSE acc END) / 100) AS auc FROM a GROUP BY seq""")
def _(t):
    return d.accuracy_auc(t("fx_obs").withColumn("e", F.col("x") % 0.15), "e", by=["seq"])


@query("d17_contact_accuracy", "SELECT seq, R6(avg(CASE WHEN (conf < 5e-1) = (vis - 5e-1 > 0) THEN 1e0 ELSE 0e0 END)) AS contact_accuracy FROM fx_obs GROUP BY seq")
def _(t):
    both = d.decode_contacts(t("fx_obs"), "conf", "distance", 0.5, "pr")
    both = d.decode_contacts(both.withColumn("logit", F.col("vis") - 0.5), "logit", "logit", out="gt")
    return d.contact_accuracy(both, F.col("pr"), F.col("gt"), ["seq"])


@query("d18_contact_distance_error", """SELECT a.idx, R6(list_sum(list_transform(range(1, 9), lambda i: abs(a.cells[i] - b.cells[i]))) / 8) AS contact_distance_error
FROM fx_thumbs a JOIN fx_thumbs b ON b.idx = a.idx + 1""")
def _(t):
    thumbs = t("fx_thumbs").select("idx", F.col("cells").alias("gt"))
    after = t("fx_thumbs").select((F.col("idx") - 1).alias("idx"), F.col("cells").alias("pr"))
    return d.contact_distance_error(thumbs.join(after, "idx"), "pr", "gt").select("idx", "contact_distance_error")


@query("d19_hand_contact_accuracy", """WITH h AS (SELECT cloud, pid, x, y, z FROM fx_points WHERE pid % 5 = 0), o AS (SELECT cloud, side, x, y, z FROM fx_points WHERE pid % 5 <> 0),
n AS (SELECT h.cloud, h.pid, o.side, min(sqrt(power(h.x - o.x, 2) + power(h.y - o.y, 2) + power(h.z - o.z, 2))) < 1e-1 AS near FROM h JOIN o ON h.cloud = o.cloud GROUP BY h.cloud, h.pid, o.side)
SELECT a.cloud, R6(avg(CASE WHEN a.near = b.near THEN 1e0 ELSE 0e0 END)) AS hand_contact_accuracy FROM n a JOIN n b ON a.cloud = b.cloud AND a.pid = b.pid AND a.side = 1 AND b.side = 0 GROUP BY a.cloud""")
def _(t):
    p = t("fx_points")
    hands, rest = p.where("pid % 5 = 0"), p.where("pid % 5 <> 0")
    return d.hand_contact_accuracy(hands, hands, rest.where("side = 1"), rest.where("side = 0"), ["cloud"], 0.1)


@query("d21_metric_meter", """WITH l AS (SELECT seq, frame, sin(x * 9) AS x, 1 + event_id % 3 AS n FROM fx_obs)
SELECT seq, frame, R6(sum(x * n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (w ROWS UNBOUNDED PRECEDING)) AS global_avg,
  R6(quantile_disc(x, 5e-1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS median, R6(avg(x) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS "avg",
  R6(max(x) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS "max" FROM l WINDOW w AS (PARTITION BY seq ORDER BY frame)""")
def _(t):
    log = t("fx_obs").withColumn("n", 1 + F.col("event_id") % 3).withColumn("x", F.sin(F.col("x") * 9))
    return d.metric_meter(log, "x", "n", ["seq"], "frame").select("seq", "frame", "global_avg", "median", "avg", "max")


@query("d22_topk_accuracy", """WITH s AS (SELECT seq, cam, max(x) AS score, seq % 4 AS label FROM fx_obs GROUP BY seq, cam), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, cam) AS p FROM s)
SELECT R6(sum(CASE WHEN p <= 1 AND cam = label THEN 1 ELSE 0 END) * 100e0 / count(DISTINCT seq)) AS top1, R6(sum(CASE WHEN p <= 2 AND cam = label THEN 1 ELSE 0 END) * 100e0 / count(DISTINCT seq)) AS top2 FROM r""")
def _(t):
    scores = t("fx_obs").groupBy("seq", "cam").agg(F.max("x").alias("score")).withColumn("label", F.col("seq") % 4)
    return d.topk_accuracy(scores, "seq", "cam", "score", "label", [1, 2])


@query("d23_frame_convention")
def _(t):
    return d.frame_convention(t("fx_pose_gt"), t("fx_pose_pr"))


@query("d24_energy_terms", """WITH o AS (SELECT * FROM fx_obs), r AS (SELECT seq, frame, avg(conf * (abs(u - 512) + abs(v - 384))) AS value FROM fx_rays GROUP BY seq, frame),
a AS (SELECT seq, frame, x * x + y * y AS value FROM o WHERE tracked), c AS (SELECT seq, frame, power(z - 2, 2) AS value FROM o WHERE conf > 5e-1),
s AS (SELECT seq, frame, value FROM (SELECT seq, frame, power(lead(x) OVER w - 2 * x + lag(x) OVER w, 2) + power(lead(y) OVER w - 2 * y + lag(y) OVER w, 2) AS value FROM o WINDOW w AS (PARTITION BY seq ORDER BY frame)) q WHERE value IS NOT NULL)
SELECT o.seq, o.frame, R6(coalesce(r.value, 0)) AS reproj, R6(coalesce(a.value, 0)) AS anchor, R6(coalesce(c.value, 0)) AS contact, R6(coalesce(s.value, 0)) AS accel,
  R6(coalesce(r.value, 0) * 1e-2 + coalesce(a.value, 0) * 2 + coalesce(c.value, 0) * 5e-1 + coalesce(s.value, 0) * 10) AS total
FROM o LEFT JOIN r ON o.seq = r.seq AND o.frame = r.frame LEFT JOIN a ON o.seq = a.seq AND o.frame = a.frame LEFT JOIN c ON o.seq = c.seq AND o.frame = c.frame LEFT JOIN s ON o.seq = s.seq AND o.frame = s.frame""")
def _(t):
    from pyspark.sql import Window

    obs, w = t("fx_obs"), Window.partitionBy("seq").orderBy("frame")
    second = lambda n: F.pow(F.lead(n).over(w) - 2.0 * F.col(n) + F.lag(n).over(w), 2)
    terms = {
        "reproj": t("fx_rays").groupBy("seq", "frame").agg(F.avg(F.col("conf") * (F.abs(F.col("u") - 512) + F.abs(F.col("v") - 384))).alias("value")),
        "anchor": obs.where("tracked").withColumn("value", F.col("x") * F.col("x") + F.col("y") * F.col("y")),
        "contact": obs.where("conf > 0.5").withColumn("value", F.pow(F.col("z") - 2.0, 2)),
        "accel": obs.withColumn("value", second("x") + second("y")),
    }
    return d.energy_terms(terms, {"reproj": 0.01, "anchor": 2.0, "contact": 0.5, "accel": 10.0})
