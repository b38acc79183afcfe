"""Queries of the temporal, ranking and set operators."""

from pyspark.sql import functions as F

from capture_tables.operators import ranking as k
from capture_tables.operators import ranges as r
from capture_tables.operators import sets as h
from capture_tables.operators import temporal as e
from capture_tables.plans.registry import query

_RUNS = """runs AS (
  SELECT seq, CAST(min(frame) AS INTEGER) AS lo, CAST(max(frame) AS INTEGER) AS hi, count(*) AS tracked, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS length FROM (
    SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY frame) AS run FROM (
      SELECT seq, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY seq ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS new
      FROM fx_obs WHERE tracked) a) b GROUP BY seq, run)"""


@query("e1_tracked_runs", f"WITH {_RUNS} SELECT seq, lo, hi, tracked, length FROM runs")
def _(t):
    return e.tracked_runs(t("fx_obs"), F.col("tracked"), 1)


@query("e1_tracked_runs_long", """WITH o AS (SELECT event_id AS frame, CASE WHEN event_id - lag(event_id) OVER (ORDER BY event_id) <= 2 THEN 0 ELSE 1 END AS new FROM events WHERE event_type <> 'error'),
i AS (SELECT frame, sum(new) OVER (ORDER BY frame) AS run FROM o) SELECT min(frame) AS lo, max(frame) AS hi, count(*) AS tracked, max(frame) - min(frame) + 1 AS length FROM i GROUP BY run""")
def _(t):
    """All events as one sequence, their ids as frames."""
    return r.tracked_runs(t("events").withColumn("frame", F.col("event_id")), F.col("event_type") != "error", 1, [])


@query("e8_last_mask_long", """SELECT event_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (ORDER BY event_id) AS source_frame FROM events""")
def _(t):
    """All events as one sequence: the last view up to each."""
    return r.last_where(t("events").select("event_id", "event_type"), F.col("event_type") == "view", "event_id", []).select("event_id", "source_frame")


@query("e2_trim_to_run", f"""WITH {_RUNS}, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY length DESC, lo) AS rk FROM runs) q WHERE rk = 1)
SELECT o.seq, o.frame, CAST(o.frame - lo AS INTEGER) AS new_frame, R6(tracked_n * 100e0 / length) AS coverage
FROM fx_obs o JOIN (SELECT seq, lo, hi, tracked AS tracked_n, length FROM best) b ON o.seq = b.seq AND o.frame BETWEEN lo AND hi""")
def _(t):
    return e.trim_to_run(t("fx_obs"), F.col("tracked"), 1).select("seq", "frame", "new_frame", "coverage")


_CLIPS = """clips AS (
  SELECT o.seq, o.frame, CAST(s.clip AS INTEGER) AS clip, CAST(o.frame - s.clip AS INTEGER) AS pos, o.vis, o.conf FROM fx_obs o JOIN (
    SELECT seq, unnest(range(0, n - 16 + 1, 8)) AS clip FROM (SELECT seq, count(*) AS n FROM fx_obs GROUP BY seq) a WHERE n >= 16) s
  ON o.seq = s.seq AND o.frame BETWEEN s.clip AND s.clip + 15)"""


@query("e3_sliding_clips", f"WITH {_CLIPS} SELECT seq, frame, clip, pos FROM clips")
def _(t):
    return e.sliding_clips(t("fx_obs"), 16, 8).select("seq", "frame", "clip", "pos")


@query("e4_filter_clips", f"""WITH {_CLIPS} SELECT seq, clip, count(*) AS frames FROM clips GROUP BY seq, clip
HAVING min(conf) >= 1e-1 AND NOT avg(conf) < 4e-1""")
def _(t):
    clips = e.sliding_clips(t("fx_obs"), 16, 8)
    kept = e.filter_clips(e.filter_clips(clips, "conf", "drop-occ", 0.1), "conf", "fp-error", 0.4)
    return kept.groupBy("seq", "clip").agg(F.count("*").alias("frames"))


@query("e4_filter_clips_random")
def _(t):
    """Clips that are visible throughout go with probability one half."""
    clips = e.sliding_clips(t("fx_obs"), 16, 8)
    return e.filter_clips(clips, "conf", "mixed", 0.1, 0.5, seed=3).groupBy("seq", "clip").agg(F.count("*").alias("frames"))


@query("e5_chunks", """SELECT seq, CAST(floor(frame / 32) AS INTEGER) AS chunk, min(frame) AS lo, count(*) AS frames
FROM fx_obs GROUP BY 1, 2""")
def _(t):
    return e.chunks(t("fx_obs"), 32).groupBy("seq", "chunk").agg(F.min("frame").alias("lo"), F.count("*").alias("frames"))


@query("e6_differences", """SELECT seq, frame,
  R6(lead(x, 2) OVER w - 2 * lead(x, 1) OVER w + x) AS d2_x, R6(lead(y, 2) OVER w - 2 * lead(y, 1) OVER w + y) AS d2_y,
  R6(lead(x, 3) OVER w - 3 * lead(x, 2) OVER w + 3 * lead(x, 1) OVER w - x) AS d3_x,
  R6(sqrt(power(lead(x, 1) OVER w - x, 2) + power(lead(y, 1) OVER w - y, 2))) AS step
FROM fx_obs WINDOW w AS (PARTITION BY seq ORDER BY frame)""")
def _(t):
    third = e.differences(t("fx_obs"), ["x"], 3).drop("step")
    return e.differences(third, ["x", "y"], 2).select("seq", "frame", "d2_x", "d2_y", "d3_x", "step")


@query("e7_static_mask", """SELECT seq, frame, CAST(1 - max(CASE WHEN conf > 7e-1 THEN 1 ELSE 0 END) OVER
  (PARTITION BY seq ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS INTEGER) AS static FROM fx_obs""")
def _(t):
    return e.static_mask(t("fx_obs"), F.col("conf") > 0.7).select("seq", "frame", "static")


@query("e8_forward_fill_mask", """SELECT seq, frame, last_value(CASE WHEN conf * 30 >= 20 THEN frame END IGNORE NULLS) OVER
  (PARTITION BY seq, floor(frame / 12) ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source_frame FROM fx_obs""")
def _(t):
    masks = t("fx_obs").withColumn("area", F.col("conf") * 30)
    return e.forward_fill_mask(masks, "area", 20, 12).select("seq", "frame", "source_frame")


@query("e9_visibility_gap", """SELECT seq, frame, frame - seen AS gap, R6(13e0 + (frame - seen) * 5e-1) AS gate FROM (
  SELECT seq, frame, last_value(CASE WHEN vis > 5e-1 THEN frame END IGNORE NULLS) OVER
    (PARTITION BY seq ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM fx_obs) a""")
def _(t):
    return e.visibility_gap(t("fx_obs"), "vis", 0.5, 0.5).select("seq", "frame", "gap", "gate")


@query("e10_split_sequences", """SELECT seq, frame, CAST(row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS INTEGER) AS pos,
  min(frame) OVER (PARTITION BY seq) AS first_frame, max(frame) OVER (PARTITION BY seq) AS last_frame FROM fx_obs WHERE tracked""")
def _(t):
    return e.split_sequences(t("fx_obs").where("tracked")).select("seq", "frame", "pos", "first_frame", "last_frame")


@query("e11_timeline", """WITH n AS (SELECT seq, max(frame) + 1 AS n FROM fx_obs GROUP BY seq),
b AS (SELECT seq, CAST(i AS INTEGER) AS bucket, floor(i * n / 10) AS lo, greatest(floor(i * n / 10) + 1, floor((i + 1) * n / 10)) AS hi
  FROM n, (SELECT unnest(range(0, 10)) AS i) r)
SELECT o.seq, bucket, bool_and(tracked) AS green FROM fx_obs o JOIN b ON o.seq = b.seq AND o.frame >= lo AND o.frame < hi GROUP BY o.seq, bucket""")
def _(t):
    return e.timeline(t("fx_obs"), F.col("tracked"), 10)


@query("e12_thin", """SELECT seq, frame, R6(x) AS x FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS k,
  greatest(1, floor(count(*) OVER (PARTITION BY seq) / 12)) AS step FROM fx_obs) a WHERE k % step = 0""")
def _(t):
    return e.thin(t("fx_obs"), 12).select("seq", "frame", "x")


@query("e13_missing_frames", """SELECT s.seq, CAST(f AS INTEGER) AS frame FROM (
  SELECT seq, unnest(range(greatest(min(frame), 5), least(max(frame), 60) + 1)) AS f FROM fx_obs WHERE tracked GROUP BY seq) s
WHERE NOT EXISTS (SELECT 1 FROM fx_obs o WHERE o.tracked AND o.seq = s.seq AND o.frame = s.f)""")
def _(t):
    return e.missing_frames(t("fx_obs").where("tracked"), 5, 60)


@query("e14_reverse_clips")
def _(t):
    """Clips turned round in time under a coin for each clip."""
    clips = e.sliding_clips(t("fx_obs"), 16, 16)
    return e.reverse_clips(clips, 0.5, seed=5).select("seq", "clip", "frame", "pos", "reversed")


@query("e15_offset_margin", """WITH b AS (SELECT seq, arg_min(frame, x * 1000 + frame / 1000e0) AS best_offset, min(x) AS best_score FROM fx_obs GROUP BY seq),
r AS (SELECT o.seq, min(x) AS rs, min(struct_pack(x := x, f := frame)).f AS rf FROM fx_obs o JOIN b ON o.seq = b.seq AND abs(frame - best_offset) > 2 GROUP BY o.seq)
SELECT b.seq, best_offset, R6(best_score) AS best_score, rf AS rival_offset, R6((rs - best_score) / rs * 100) AS margin,
  (rs - best_score) / rs * 100 < 25 AS ambiguous FROM b LEFT JOIN r ON b.seq = r.seq""")
def _(t):
    return e.offset_margin(t("fx_obs").select("seq", F.col("frame").alias("offset"), F.col("x").alias("score")), ["seq"])


@query("e19_registration_frames", """SELECT seq, frame, (row_number() OVER (PARTITION BY seq ORDER BY frame) - 1) % 15 = 0 AS register FROM fx_obs""")
def _(t):
    return e.registration_frames(t("fx_obs"), 15).select("seq", "frame", "register")


@query("f1_rank_hypotheses", """SELECT seq, cam, frame, CAST(row_number() OVER (PARTITION BY seq, cam ORDER BY conf DESC, frame) AS INTEGER) AS "rank" FROM fx_obs""")
def _(t):
    return k.rank_hypotheses(t("fx_obs"), "conf", "frame", ["seq", "cam"]).select("seq", "cam", "frame", "rank")


@query("f2_top_frames", "SELECT seq, frame, R6(vis) AS vis FROM fx_obs ORDER BY vis DESC, seq, frame LIMIT 25")
def _(t):
    return k.top_frames(t("fx_obs"), "vis", 25, "seq", "frame").select("seq", "frame", "vis")


@query("f3_nth_run", f"""WITH {_RUNS} SELECT seq, lo, hi, tracked, length FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY length DESC, lo) AS rk FROM runs) q WHERE rk = 2""")
def _(t):
    return e.nth_run(e.tracked_runs(t("fx_obs"), F.col("tracked"), 1), 2)




@query("f4_keep_kth", """SELECT seq, frame, R6(vis) AS vis FROM (SELECT *, max(CASE WHEN p = least(31, n) THEN vis END) OVER (PARTITION BY seq) AS bound FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY vis DESC) AS p, count(*) OVER (PARTITION BY seq) AS n FROM fx_obs) a) b WHERE vis >= bound""")
def _(t):
    return k.keep_kth(t("fx_obs"), "vis", 31).select("seq", "frame", "vis")


@query("f5_refine_range", """SELECT seq, R6(min(z) * 8e-1) AS lo, R6(max(z) * 12e-1) AS hi FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY x, z) AS p FROM fx_obs) a WHERE p <= 3 GROUP BY seq""")
def _(t):
    return k.refine_range(t("fx_obs"), "z", "x")


@query("f7_sorted_tracks", "SELECT seq, frame, R6(x) AS x FROM fx_obs WHERE tracked")
def _(t):
    """Written in frame order within each sequence, and read again."""
    from capture_tables.functions.shared import shared_path

    track = t("fx_obs").where("tracked").select("seq", "frame", "x")
    path = shared_path(track.sparkSession, "sorted")
    k.write_sorted(track, path)
    return track.sparkSession.read.parquet(path)


@query("f8_probe_frames", """SELECT DISTINCT seq, CAST(floor(i * ((n - 1) / 7e0)) AS INTEGER) AS frame
FROM (SELECT seq, count(*) AS n FROM fx_obs GROUP BY seq) a, (SELECT unnest(range(0, 8)) AS i) r""")
def _(t):
    return k.probe_frames(t("fx_obs").groupBy("seq").agg(F.count("*").alias("n")), 8)


@query("h1_common_frames", "SELECT seq, frame FROM fx_obs WHERE tracked INTERSECT SELECT seq, frame FROM fx_excl")
def _(t):
    return h.common_frames(t("fx_obs").where("tracked"), t("fx_excl"))


@query("h2_covered_frames", """SELECT seq, frame, count(DISTINCT cam) AS views FROM (
  SELECT seq, frame, cam FROM fx_rays WHERE conf > 5e-1 UNION ALL SELECT seq, frame, cam + 10 FROM fx_obs) a
GROUP BY seq, frame HAVING count(DISTINCT cam) >= 2""")
def _(t):
    rays = t("fx_rays").where("conf > 0.5").select("seq", "frame", "cam")
    return h.covered_frames(rays.unionByName(t("fx_obs").select("seq", "frame", (F.col("cam") + 10).alias("cam"))), 2)


@query("h3_minus_frames", "SELECT o.seq, o.frame FROM fx_obs o WHERE NOT EXISTS (SELECT 1 FROM fx_excl x WHERE x.seq = o.seq AND x.frame = o.frame)")
def _(t):
    return h.minus_frames(t("fx_obs").select("seq", "frame"), t("fx_excl"))


@query("h4_append_hypotheses", """SELECT seq, frame, R6(tx) AS tx, 'depth' AS source FROM fx_pose_gt
UNION ALL SELECT seq, frame, R6(tx), 'rgb' FROM fx_pose_pr""")
def _(t):
    return h.append_hypotheses(depth=t("fx_pose_gt").select("seq", "frame", "tx"), rgb=t("fx_pose_pr").select("seq", "frame", "tx"))


@query("h5_split_examples", """SELECT CASE WHEN seq % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT seq) AS seqs FROM fx_obs GROUP BY 1""")
def _(t):
    both = h.split_examples(t("fx_obs"), F.col("seq") % 10 < 8)
    return both.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"))
