"""Queries of the recurrences, the extension points and the streams. A stream reads the events
rewritten as several files in order of time, runs to its end and is read back."""

from pyspark.sql import functions as F

from capture_tables.functions.shared import shared_path
from capture_tables.operators import extension as u
from capture_tables.operators import filters as f
from capture_tables.operators import geometry as g
from capture_tables.operators import metrics as d
from capture_tables.plans.registry import query
from capture_tables.streaming import frames as s

_R = [f"r{i}{j}" for i in range(3) for j in range(3)]


@query("e16_one_euro")
def _(t):
    return f.one_euro(t("fx_obs"), ["x", "y", "z"], ["seq"])


@query("e17_one_euro_rotation")
def _(t):
    return f.one_euro_rotation(t("fx_pose_pr"), ["seq"], "tangent", freq=30.0)


@query("e17_one_euro_geodesic")
def _(t):
    return f.one_euro_rotation(t("fx_pose_pr"), ["seq"], "geodesic", freq=30.0)


@query("e18_select_track")
def _(t):
    """Both pose tables as two hypotheses for each frame."""
    vis = t("fx_obs").select("seq", "frame", "vis")
    hyp = lambda name, k: t(name).join(vis, ["seq", "frame"]).select("seq", "frame", F.lit(k).alias("rank"), F.col("vis").alias("visibility"), *_R)
    return f.select_track(hyp("fx_pose_gt", 0).unionByName(hyp("fx_pose_pr", 1)), ["seq"])


@query("u1_evaluator", """SELECT g.seq, g.frame, R6(sqrt(power(p.tx - g.tx, 2) + power(p.ty - g.ty, 2) + power(p.tz - g.tz, 2))) AS root, R6(abs(p.tx - g.tx)) AS x_only FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame""")
def _(t):
    evaluator = u.Evaluator()
    evaluator.metric("root")(lambda x: d.root_error(x["pr"], x["gt"]).withColumnRenamed("root_error", "value"))

    @evaluator.metric("x_only")
    def _own(x):
        other = x["gt"].select("seq", "frame", F.col("tx").alias("gx"))
        return x["pr"].join(other, ["seq", "frame"]).withColumn("value", F.abs(F.col("tx") - F.col("gx")))

    return evaluator.run({"pr": t("fx_pose_pr"), "gt": t("fx_pose_gt")})


@query("u2_depth_provider", "SELECT frame, v, u, R6(z * 2 + 1) AS z FROM fx_depth")
def _(t):
    return u.align_depth(t("fx_depth"), lambda p: p.withColumn("z", F.col("z") * 2 + 1), ["seq"], ("frame", "v", "u")).select("frame", "v", "u", "z")


@query("u3_depth_steps", "SELECT frame, v, u, R6(z / 2) AS z FROM fx_depth WHERE z < 5e0")
def _(t):
    return u.preprocessed(t("fx_depth"), lambda x: x.where("z < 5"), lambda x: x.withColumn("z", F.col("z") / 2)).select("frame", "v", "u", "z")


@query("u4_augmentations", "SELECT frame, v, u, R6(z * 2 - 1e-1) AS z FROM fx_depth WHERE NOT (abs(u - 20) <= 5 AND abs(v - 3) <= 1)")
def _(t):
    specs = [{"kind": "box", "u": 20.0, "v": 3.0, "a": 5.0, "b": 1.0}, {"kind": "scale", "gain": 2.0, "offset": -0.1}]
    return u.augmented(t("fx_depth"), specs, 3, "frame", "v", "u").select("frame", "v", "u", "z")


#: Events in a file.
EVENTS = 1_000_000


def _stream(t, extra=()):
    """The events as a stream: seq, event_id, ts, x, vis, tracked and more columns."""
    e = t("events")
    spark = e.sparkSession
    path = shared_path(spark, "events")
    # one write for each quarter of the time, so that files arrive in order of time; all files
    # of a quarter are taken at once, since a part of them would make the others late
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = e.agg(F.min(at).alias("lo"), (F.max(at) + 1).alias("hi"), F.count("*").alias("n")).first()
    files = max(4, span["n"] // (4 * EVENTS))
    quarter = F.floor((at - span["lo"]) * 4 / (span["hi"] - span["lo"]))
    for k in range(4):
        e.where(quarter == k).repartition(files).write.mode("append").parquet(path)
    rows = s.read_frames(spark, path, e.schema, files)
    x = F.col("event_id")
    return rows.select(
        F.col("user_id").alias("seq"), "event_id", "ts", "event_type", (F.col("value") / 100.0).alias("x"), ((x % 13) / 12.0).alias("vis"),
        (x % 4).cast("int").alias("cam"), (F.col("event_type") != "error").alias("tracked"), *extra)


#: Events of a batch, a quarter of all, for one part of a stream's states.
STATE_EVENTS = 100_000


def _done(t, stream, mode="append"):
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    # each part costs some 0.4 s in every batch, whatever it holds
    parts = max(spark.sparkContext.defaultParallelism, -(-t("events").count() // (4 * STATE_EVENTS)))
    running = s.write_frames(stream, path, mode, parts)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def _finished(t, stream):
    """Windows that closed: the last ones stay open until the watermark passes."""
    return _done(t, stream)


_E = "(SELECT user_id AS seq, event_id, ts, event_type, value / 100e0 AS x, (event_id % 13) / 12e0 AS vis, event_type <> 'error' AS tracked FROM events)"
_MARK = "(SELECT max(ts) FROM events)"


@query("s1_deduplicated", f"SELECT seq, event_id, R6(x) AS x FROM {_E} e")
def _(t):
    """Every event twice in the stream, once behind it."""
    once = _stream(t)
    both = once.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return _done(t, s.deduplicated(both, "1 hour", ["seq", "event_id"]).select("seq", "event_id", "x"))


@query("s2_quality_windows", f"""SELECT seq, w AS start, frames, R6(pct) AS tracked_pct, R6(res) AS mean_residual FROM (SELECT seq, time_bucket(INTERVAL '6 hours', ts) AS w, count(*) AS frames, avg(CASE WHEN tracked THEN 1e0 ELSE 0e0 END) * 100 AS pct, avg(x) AS res FROM {_E} e GROUP BY 1, 2) q
WHERE w + INTERVAL '6 hours' <= {_MARK} - INTERVAL '10 minutes'""")
def _(t):
    rows = _stream(t).withColumns({"residual": F.col("x"), "ratio": F.col("vis")})
    out = _finished(t, s.quality_windows(rows, "10 minutes", "6 hours"))
    return out.select("seq", F.col("window.start").cast("timestamp_ntz").alias("start"), "frames", "tracked_pct", "mean_residual")


@query("s3_sliding_meters", f"""SELECT seq, w AS start, count(*) AS n, R6(avg(sin(x * 9))) AS "avg", R6(max(sin(x * 9))) AS "max" FROM (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM {_E} e) q WHERE w + INTERVAL '12 hours' <= {_MARK} - INTERVAL '10 minutes' GROUP BY seq, w""")
def _(t):
    rows = _stream(t).withColumn("value", F.sin(F.col("x") * 9))
    out = _finished(t, s.sliding_meters(rows, "10 minutes", "12 hours", "6 hours"))
    return out.select("seq", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "avg", "max")


@query("s4_tracked_sessions", f"""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY seq ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM {_E} e WHERE tracked), r AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY ts) AS run FROM o)
SELECT seq, min(ts) AS start, count(*) AS tracked FROM r GROUP BY seq, run HAVING max(ts) + INTERVAL '2 hours' <= {_MARK} - INTERVAL '10 minutes'""")
def _(t):
    out = _finished(t, s.tracked_sessions(_stream(t), "10 minutes", "2 hours"))
    return out.select("seq", F.col("window.start").cast("timestamp_ntz").alias("start"), "tracked")


@query("s5_smoothed")
def _(t):
    return _done(t, s.smoothed(_stream(t), "x")).select("seq", "event_id", "smooth")


@query("s6_visibility_gate", f"""WITH RECURSIVE e AS (SELECT seq, event_id, ts, epoch_us(ts) / 1e6 AS t, last_value(CASE WHEN vis > 5e-1 THEN epoch_us(ts) / 1e6 END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {_E} x),
c AS (SELECT seq, event_id, i, dense_rank() OVER (PARTITION BY seq ORDER BY ts, event_id) AS n, event_id * 7 % 40 + i * 3 AS u0, event_id * 7 % 40 + i * 3 + 3 + (event_id + i) % 5 AS u1, event_id * 13 % 40 AS p FROM e, range(3) r(i) WHERE event_id % 9 <> 0),
k AS (SELECT *, greatest(0, least(u1, p + 6) - greatest(u0, p - 2)) AS near FROM c), w AS (SELECT *, max(near) OVER (PARTITION BY seq, event_id) AS most FROM k),
own AS (SELECT seq, event_id, n, i, CASE WHEN most > 0 THEN 'person' ELSE 'largest' END AS how FROM w QUALIFY row_number() OVER (PARTITION BY seq, event_id ORDER BY CASE WHEN most > 0 THEN near ELSE u1 - u0 END DESC, i) = 1),
led AS (SELECT b.seq, b.n, a.i AS before, b.i FROM c a JOIN c b ON a.seq = b.seq AND b.n = a.n + 1 WHERE least(a.u1, b.u1) > greatest(a.u0, b.u0) QUALIFY row_number() OVER (PARTITION BY b.seq, b.n, a.i ORDER BY least(a.u1, b.u1) - greatest(a.u0, b.u0) DESC, b.i) = 1),
chain(seq, event_id, n, i, how) AS (SELECT seq, event_id, n, i, how FROM own WHERE n = 1 UNION ALL
  SELECT o.seq, o.event_id, o.n, coalesce(l.i, o.i), CASE WHEN l.i IS NULL THEN o.how ELSE 'previous' END FROM chain k JOIN own o ON o.seq = k.seq AND o.n = k.n + 1 LEFT JOIN led l ON l.seq = k.seq AND l.n = k.n + 1 AND l.before = k.i)
SELECT e.seq, e.event_id, round(t - seen, 3) AS gap, k.i AS instance, k.how AS chosen_by FROM e LEFT JOIN chain k ON k.seq = e.seq AND k.event_id = e.event_id""")
def _(t):
    """Three masks of two rows in most events, and a person."""
    rows, e = _stream(t), F.col("event_id")
    run = lambda u0, width, v, *more: F.struct(*more, F.lit(v).alias("v"), u0.cast("int").alias("u0"), (u0 + width).cast("int").alias("u1"))
    made = [run(e * 7 % 40 + i * 3, 3 + (e + i) % 5, v, F.lit(i).alias("instance")) for i in range(3) for v in range(2)]
    rows = rows.withColumns({"candidates": F.when(e % 9 != 0, F.array(*made)), "person": F.array(*[run(e * 13 % 40, F.lit(4), v) for v in range(2)])})
    return _done(t, s.visibility_gate(rows, 0.5, 0.5, d=2)).select("seq", "event_id", F.round("gap", 3).alias("gap"), "instance", "chosen_by")


@query("s7_paired", f"""SELECT c.event_id AS colour_id, d.event_id AS depth_id FROM {_E} c JOIN {_E} d ON c.seq = d.seq AND c.event_type = 'view' AND d.event_type = 'click' AND d.ts BETWEEN c.ts - INTERVAL 30 MINUTE AND c.ts + INTERVAL 30 MINUTE
WHERE c.ts + INTERVAL 30 MINUTE <= {_MARK} - INTERVAL 10 HOUR QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(d.ts) - epoch_us(c.ts)), d.ts, d.event_id) = 1""")
def _(t):
    """Pairs that the watermark has settled."""
    colour, depth = _stream(t).where("event_type = 'view'"), _stream(t).where("event_type = 'click'")
    return _done(t, s.paired(colour, depth, 1800.0, "10 hours")).select("colour_id", "depth_id")


@query("s8_with_calibration", f"SELECT e.event_id, R6(c.fx) AS fx FROM {_E} e JOIN fx_cameras c ON c.cam = e.event_id % 4")
def _(t):
    return _done(t, s.with_calibration(_stream(t), t("fx_cameras").select("cam", "fx"))).select("event_id", "fx")


@query("s9_live_triangulation", f"""WITH r AS (SELECT seq, time_bucket(INTERVAL '6 hours', ts) AS start, ts, event_id % 4 AS cam FROM {_E} e),
f AS (SELECT *, first_value(cam) OVER w AS first, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY seq, start ORDER BY ts, cam))
SELECT seq, start, 5e-1 AS x, 1e-1 AS y, 7e0 AS z, min(n) AS n_views FROM f WHERE cam <> first GROUP BY seq, start""")
def _(t):
    """Rays of the events' cameras towards one point for each sequence and six hours: a row for each of
    these spans, also of those that are still open when the stream ends, from its first two cameras."""
    rows = _stream(t)
    target = rows.withColumns({"y": F.lit(0.1), "z": F.lit(7.0)}).join(t("fx_cameras").select("cam", *[c for c in t("fx_cameras").columns if c not in ("cam", "width", "height")]), "cam")
    seen = target.withColumns({"px": F.col("r00") * 0.5 + F.col("r02") * F.col("z") + F.col("tx"), "py": F.col("y") + F.col("ty"), "pz": F.col("r20") * 0.5 + F.col("r22") * F.col("z") + F.col("tz")})
    pixels = seen.withColumns({"u": F.col("fx") * F.col("px") / F.col("pz") + F.col("cx"), "v": F.col("fy") * F.col("py") / F.col("pz") + F.col("cy")})
    frame = F.window("ts", "6 hours")["start"].cast("timestamp").alias("start")
    out = _done(t, s.live_triangulation(g.camera_rays(pixels.select("seq", frame, "ts", "cam", "u", "v"), t("fx_cameras")), "10 minutes", 86400.0, ["seq", "start"]))
    return out.select("seq", F.col("start").cast("timestamp_ntz").alias("start"), "x", "y", "z", "n_views")


@query("s10_upserted", f"SELECT seq, max(event_id) AS event_id, count(*) AS n FROM (SELECT seq, event_id FROM {_E} e) q GROUP BY seq")
def _(t):
    rows = _stream(t).select("seq", "event_id", (F.col("seq") % 5).cast("int").alias("part"))
    spark = rows.sparkSession
    path = shared_path(spark, "upsert")
    s.upsert_frames(rows, path, ["seq", "event_id"], "part").awaitTermination()
    back = s.read_upserted(spark, path, rows.schema, "part")
    return back.groupBy("seq").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
