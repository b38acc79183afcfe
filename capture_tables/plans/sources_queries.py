"""Queries of the readers and sinks: files that Spark derives from the tables, read back."""

from pyspark.sql import functions as F

from capture_tables.functions.shared import shared_path
from capture_tables.operators import metrics as d
from capture_tables.plans.registry import query
from capture_tables.sources import readers as a
from capture_tables.sources import sinks


#: Rows of one document.
UNIT = 200


def _each(rows, value):
    """A file for each document of up to UNIT customers, so that files grow in number."""
    path = shared_path(rows.sparkSession, "docs")
    unit = F.floor(F.col("c_custkey") / UNIT)
    rows.groupBy(unit.alias("unit")).agg(value.alias("value")).repartition("unit").write.partitionBy("unit").text(path)
    return path + "/*"


_NAME = "'s' || c_custkey"


@query("a1_read_splits", f"SELECT {_NAME} AS seq, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def _(t):
    seq = F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    pick = lambda test: F.collect_list(F.when((F.col("c_custkey") % 5 == 0) == test, seq))
    path = _each(t("customer"), F.to_json(F.struct(pick(F.lit(False)).alias("train"), pick(F.lit(True)).alias("test"))))
    return a.read_splits(t("customer").sparkSession, path)


@query("a2_read_exclusions", f"""SELECT {_NAME} AS seq, 't' || lpad(cast(c_custkey % 60 as varchar), 4, '0') || '.000' AS frame_key, cast(c_custkey % 4 as int) AS cam FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT {_NAME}, NULL, cast(c_custkey % 4 as int) FROM customer WHERE c_custkey % 7 = 0""")
def _(t):
    k = F.col("c_custkey")
    view = F.concat(F.lit("s"), k.cast("string"), F.lit("/k"), (k % 4).cast("string"))
    frame = F.concat(F.lit("s"), k.cast("string"), F.lit("/t"), F.lpad((k % 60).cast("string"), 4, "0"), F.lit(".000/k"), (k % 4).cast("string"))
    value = F.to_json(F.struct(F.collect_list(F.when(k % 3 == 0, frame)).alias("frames"), F.collect_list(F.when(k % 7 == 0, view)).alias("exclude")))
    frames, views = a.read_exclusions(t("customer").sparkSession, _each(t("customer"), value))
    return frames.unionByName(views, allowMissingColumns=True)


@query("a3_read_selected_views", f"SELECT {_NAME} AS seq, cast(c_custkey % 4 as int) AS cam FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    k = F.col("c_custkey")
    pair = F.struct(F.concat(F.lit("s"), k.cast("string")).alias("key"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("value"))
    value = F.to_json(F.map_from_entries(F.collect_list(F.when(k % 2 == 0, pair))))
    return a.read_selected_views(t("customer").sparkSession, _each(t("customer"), value))


@query("a4_read_calibration", """SELECT cast(s_suppkey as varchar) AS cam, 1408 AS width, 'KANNALABRANDTK3' AS model, R6(600e0 + s_nationkey) AS k0, R6(cos(s_suppkey / 10e0)) AS r00, R6(-sin(s_suppkey / 10e0)) AS r02, R6(-(cos(s_suppkey / 10e0) * s_nationkey - sin(s_suppkey / 10e0) * 2)) AS tx FROM supplier""")
def _(t):
    s, half = t("supplier"), F.col("s_suppkey") / F.lit(20.0)
    values = {"cam": F.col("s_suppkey").cast("string"), "image_width": F.lit(1408), "image_height": F.lit(1408), "intrinsics_type": F.lit("KANNALABRANDTK3"), "intrinsics_0": 600.0 + F.col("s_nationkey")}
    values |= {f"intrinsics_{i}": F.lit(0.1 * i) for i in range(1, 8)}
    values |= {"tx": F.col("s_nationkey").cast("double"), "ty": F.lit(1.0), "tz": F.lit(2.0), "qx": F.lit(0.0), "qy": F.sin(half), "qz": F.lit(0.0), "qw": F.cos(half)}
    path = shared_path(s.sparkSession, "calibration")
    s.select(*[v.alias(n) for n, v in values.items()]).write.csv(path, header=True)
    return a.read_calibration(s.sparkSession, path).select("cam", "width", "model", "k0", "r00", "r02", "tx")


_CELL = [[(i * 4 + j) / 10 for j in range(4)] for i in range(3)]


@query("a5_read_frame_poses", "SELECT cast(c_custkey as int) AS frame, R6(c_acctbal / 7 + 5e-1) AS r11, R6(c_acctbal / 7 + 1e0) AS r22, R6(c_acctbal / 7 + 3e-1) AS tx, R6(c_acctbal / 7 + 11e-1) AS tz FROM customer")
def _(t):
    rows = F.array(*[F.array(*[F.col("c_acctbal") / 7 + c for c in row]) for row in _CELL])
    value = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("key"), rows.alias("value")))))
    return a.read_frame_poses(t("customer").sparkSession, _each(t("customer"), value)).select("frame", "r11", "r22", "tx", "tz")


@query("a6_read_rgb_params", "SELECT 'camera-rgb' AS label, 'f624' AS model, R6(sum(i * (7 + (SELECT arg_min(c_acctbal, c_custkey) FROM customer)))) AS weighted FROM (SELECT unnest(range(0, 15)) AS i) r")
def _(t):
    params = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: i * (7 + F.col("c_acctbal")))
    cam = lambda label: F.struct(F.lit(label).alias("label"), F.lit("f624").alias("model"), params.alias("params"))
    rows = t("customer").select(F.col("c_custkey").alias("timestamp"), F.array(cam("slam-left"), cam("camera-rgb")).alias("cameras"))
    path = shared_path(rows.sparkSession, "rgb")
    rows.write.json(path)
    found = a.read_rgb_params(rows.sparkSession, path)
    return found.select("label", "model", F.aggregate("params", F.lit(0.0), lambda s, x: s + x).alias("weighted"))


@query("a7_read_frame_times", """SELECT c_custkey // 200 AS unit, 'color' AS stream, cast(row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) - 1 as int) AS frame, R6(c_custkey * 33333 / 1e6) AS t_sec FROM customer""")
def _(t):
    stamps = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: k * 33333)
    path = _each(t("customer"), F.to_json(F.struct(stamps.alias("color"), F.array().cast("array<long>").alias("depth"))))
    found = a.read_frame_times(t("customer").sparkSession, path)
    return found.select(F.regexp_extract("file", "unit=([0-9]+)", 1).cast("long").alias("unit"), "stream", "frame", "t_sec")


@query("a8_unpack_arrays", """SELECT idx, cast(i - 1 as int) AS frame, cast(j - 1 as int) AS cam, R6(cells[i]) AS a, R6(cells[i * 4 + j]) AS b FROM fx_thumbs, (SELECT unnest(range(1, 9)) AS i) r, (SELECT unnest(range(1, 5)) AS j) s""")
def _(t):
    k = lambda at: F.element_at("cells", at)
    b = F.array(*[F.array(*[k(i * 4 + j) for j in range(1, 5)]) for i in range(1, 9)])
    return a.unpack_arrays(t("fx_thumbs").select("idx", F.slice("cells", 1, 8).alias("a"), b.alias("b")), ["idx"], ["a"], ["b"])


@query("a9_merge_camera_outputs", "SELECT seq, frame, c.cam, R6(x + c.cam) AS x FROM fx_obs, (SELECT cam FROM fx_cameras WHERE cam < 3) c")
def _(t):
    parts = [t("fx_obs").select("seq", "frame", F.lit(k).alias("cam"), (F.col("x") + k).alias("x")) for k in range(3)]
    return a.merge_camera_outputs(parts, 3)


@query("a10_mask_catalogue", "SELECT seq, lpad(cast(frame as varchar), 6, '0') AS frame_key, cam, 'obj' AS role FROM fx_obs")
def _(t):
    key = F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit("-k"), F.col("cam").cast("string"), F.lit(".obj.png"))
    return a.mask_catalogue(t("fx_obs").select("seq", F.col("seq").alias("group"), key.alias("key")))


@query("a11_mask_to_runs", """WITH p AS (SELECT idx, unnest(range(lo, hi)) AS p FROM (SELECT idx, 3 + idx % 5 AS lo, 3 + idx % 5 + 10 + idx % 7 AS hi FROM fx_thumbs UNION ALL SELECT idx, 3 + idx % 5 + 10 + idx % 7 + 4, 3 + idx % 5 + 10 + idx % 7 + 4 + 9 FROM fx_thumbs) q),
x AS (SELECT idx, p % 8 AS v, p // 8 AS u FROM p), g AS (SELECT *, u - row_number() OVER (PARTITION BY idx, v ORDER BY u) AS g FROM x) SELECT idx, cast(v as int) AS v, cast(min(u) as int) AS u0, cast(max(u) + 1 as int) AS u1 FROM g GROUP BY idx, v, g""")
def _(t):
    counts = F.array(3 + F.col("idx") % 5, 10 + F.col("idx") % 7, F.lit(4), F.lit(9), F.lit(11))
    return a.mask_to_runs(t("fx_thumbs").select("idx", counts.alias("counts"), F.lit(8).alias("height")), ["idx"])


@query("a12_read_clicks", "SELECT c_name AS point, 'cam' || (c_custkey % 3) AS cam, R6(c_acctbal) AS u, R6(c_acctbal / 3) AS v, cast(1000 + c_custkey % 3 as int) AS width, 768 AS height FROM customer")
def _(t):
    cam = F.concat(F.lit("cam"), (F.col("c_custkey") % 3).cast("string"))
    one = F.create_map(cam, F.array(F.col("c_acctbal"), F.col("c_acctbal") / 3))
    points = F.map_from_entries(F.collect_list(F.struct(F.col("c_name").alias("key"), one.alias("value"))))
    sizes = F.create_map(*[x for k in range(3) for x in (F.lit(f"cam{k}"), F.array(F.lit(1000 + k), F.lit(768)))])
    path = _each(t("customer"), F.to_json(F.struct(F.first(sizes).alias("resolutions"), points.alias("points"))))
    return a.read_clicks(t("customer").sparkSession, path)


@query("a13_read_seq_info", "SELECT 'unit ' || (c_custkey // 200) AS name, count(*) AS n, true AS resolved FROM customer GROUP BY 1")
def _(t):
    name = F.concat(F.lit("unit "), F.first(F.floor(F.col("c_custkey") / UNIT)).cast("string"))
    path = _each(t("customer"), F.to_json(F.struct(name.alias("name"), F.count("*").alias("n"), F.lit("calib/k0.json").alias("calib_path"))))
    found = a.read_seq_info(t("customer").sparkSession, path, "name string, n long, calib_path string")
    return found.select("name", "n", (F.col("calib_path") == F.concat("folder", F.lit("/calib/k0.json"))).alias("resolved"))


@query("a14_complete_frames", "SELECT cast(seq as varchar) AS seq, cast(frame as varchar) AS frame_key FROM fx_obs WHERE tracked AND conf > 2e-1")
def _(t):
    cams = F.explode(F.when(F.col("conf") > 0.2, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(2))))
    kinds = F.explode(F.when(F.col("tracked"), F.array(F.lit("color.jpg"), F.lit("depth.png"))).otherwise(F.array(F.lit("color.jpg"))))
    files = t("fx_obs").select("seq", "frame", cams.alias("cam"), "tracked").select("seq", "frame", "cam", kinds.alias("kind"))
    path = F.concat_ws("/", F.lit("/data"), F.col("seq").cast("string"), F.col("frame").cast("string"), F.concat(F.lit("k"), F.col("cam").cast("string"), F.lit("."), F.col("kind")))
    return a.complete_frames(files.select(path.alias("path")), 4, True)


@query("a15_clip_inventory", """WITH c AS (SELECT seq, k, count(*) AS frames FROM (SELECT seq, 'rgb' AS k FROM fx_obs UNION ALL SELECT seq, 'depth' FROM fx_obs WHERE seq % 2 = 0 OR tracked) q GROUP BY seq, k)
SELECT seq, k AS artefact, frames, R6(frames / 3e1) AS seconds, min(frames) OVER (PARTITION BY seq) = max(frames) OVER (PARTITION BY seq) AS agrees FROM c""")
def _(t):
    both = t("fx_obs").select("seq", F.lit("rgb").alias("artefact")).unionByName(t("fx_obs").where("seq % 2 = 0 or tracked").select("seq", F.lit("depth").alias("artefact")))
    return a.clip_inventory(both, ["seq"], "artefact", 30.0)


@query("a16_pending_units", "SELECT DISTINCT seq FROM fx_obs o WHERE seq % 3 <> 0 AND EXISTS (SELECT 1 FROM fx_excl x WHERE x.seq = o.seq) AND EXISTS (SELECT 1 FROM fx_obs p WHERE p.seq = o.seq AND p.conf > 9e-1)")
def _(t):
    units = t("fx_obs").select("seq").distinct()
    return a.pending_units(units, units.where("seq % 3 = 0"), t("fx_excl"), t("fx_obs").where("conf > 0.9"))


@query("a17_write_metrics", "SELECT 'base' AS run, cast(g.seq as int) AS seq, count(*) AS frames, R6(avg(sqrt(power(p.tx - g.tx, 2) + power(p.ty - g.ty, 2) + power(p.tz - g.tz, 2)))) AS root_error FROM fx_pose_gt g JOIN fx_pose_pr p ON g.seq = p.seq AND g.frame = p.frame GROUP BY g.seq")
def _(t):
    frames = d.root_error(t("fx_pose_pr"), t("fx_pose_gt")).withColumn("run", F.lit("base"))
    path = shared_path(frames.sparkSession, "metrics")
    sinks.write_metrics(frames, d.summarise(frames, ["root_error"]), path)
    back = frames.sparkSession.read.parquet(f"{path}/frames")
    return back.groupBy("run", F.col("seq").cast("int").alias("seq")).agg(F.count("*").alias("frames"), F.avg("root_error").alias("root_error"))


@query("a18_write_track", "SELECT seq, frame, R6(x) AS x, R6(vis) AS residual FROM fx_obs WHERE vis <= 5e-1")
def _(t):
    track = t("fx_obs").select("seq", "frame", "x", F.col("vis").alias("residual"))
    path = shared_path(track.sparkSession, "track")
    sinks.write_track(track, path, 0.5)
    return track.sparkSession.read.parquet(path)


@query("a19_rename_sequence", """SELECT CASE WHEN seq = 'Date01_Sub01_building_lift' THEN 'Date01_Sub09_building_lift' ELSE seq END AS seq, count(*) AS n, (SELECT count(*) FROM fx_seqname WHERE seq = 'Date01_Sub01_building_lift') AS hits FROM fx_seqname GROUP BY 1""")
def _(t):
    old, new = "Date01_Sub01_building_lift", "Date01_Sub09_building_lift"
    names = {"names": t("fx_seqname")}
    hits = sinks.rename_sequence(names, old, new, dry_run=True)["names"]
    done = sinks.rename_sequence(names, old, new)["names"].groupBy("seq").agg(F.count("*").alias("n"))
    return done.crossJoin(F.broadcast(hits))  # one row
