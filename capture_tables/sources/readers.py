"""Readers of the capture formats: split files, calibrations, poses, clicks, masks, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_tables.functions import linalg as la


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document: its fields, by the schema."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"), F.input_file_name().alias("file"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """seq, split of a document {"train": [...], "test": [...]}."""
    doc = _document(spark, path, "train array<string>, test array<string>")
    parts = [doc.select(F.explode(f"d.{s}").alias("seq"), F.lit(s).alias("split")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames: seq, frame_key, cam; views: seq, cam) of {"frames": ["seq/key/k1"], "exclude":
    ["seq/k1"]}."""
    doc = _document(spark, path, "frames array<string>, exclude array<string>")
    part = F.split("e", "/")
    cam = F.substring(F.element_at(part, -1), 2, 9).cast("int").alias("cam")
    frames = doc.select(F.explode("d.frames").alias("e")).select(part[0].alias("seq"), part[1].alias("frame_key"), cam)
    views = doc.select(F.explode("d.exclude").alias("e")).select(part[0].alias("seq"), cam)
    return frames, views


def read_selected_views(spark: SparkSession, path: str) -> DataFrame:
    """seq, cam of {"seq": "k2"}."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("seq", "view"))
    return doc.select("seq", F.substring("view", 2, 9).cast("int").alias("cam"))


CALIBRATION = "cam string, image_width int, image_height int, intrinsics_type string, " + ", ".join(f"intrinsics_{i} double" for i in range(8)) + ", tx double, ty double, tz double, qx double, qy double, qz double, qw double"
KNOWN_LENS = "KANNALABRANDTK3"


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a CSV with a header (CALIBRATION): intrinsics and the world-to-camera r, t from
    the camera's pose in the world; another lens model than the known one is an error."""
    raw = spark.read.csv(path, schema=CALIBRATION, header=True)
    lens = F.when(F.col("intrinsics_type") == KNOWN_LENS, F.col("intrinsics_type")).otherwise(F.raise_error(F.concat(F.lit("unknown lens model "), F.coalesce("intrinsics_type", F.lit("none")))))
    turn = la.transpose(la.from_quaternion(la.columns("qw", "qx", "qy", "qz")))
    shift = [-c for c in la.apply(turn, la.columns("tx", "ty", "tz"))]
    return raw.select(
        "cam", F.col("image_width").alias("width"), F.col("image_height").alias("height"), lens.alias("model"),
        *[F.col(f"intrinsics_{i}").alias(f"k{i}") for i in range(8)], *la.named(turn), *[s.alias(f"t{a}") for s, a in zip(shift, "xyz", strict=True)],
    )


def read_frame_poses(spark: SparkSession, path: str) -> DataFrame:
    """frame, r00 .. r22, tx, ty, tz of {"frame": [[3 x 4]]}."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("frame", "m"))
    cells = [F.col("m")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return doc.select(F.col("frame").cast("int").alias("frame"), *cells, *[F.col("m")[i][3].alias(f"t{a}") for i, a in enumerate("xyz")])


def read_rgb_params(spark: SparkSession, path: str, n: int = 15) -> DataFrame:
    """label, model, params of the earliest record of a JSON-lines file, its RGB camera; an error
    unless it has n parameters."""
    rows = spark.read.schema("timestamp long, cameras array<struct<label:string,model:string,params:array<double>>>").json(path)
    cams = rows.select("timestamp", F.explode("cameras").alias("c")).where(F.col("c.label").like("%rgb"))
    first = cams.agg(F.min_by("c", "timestamp").alias("c"))
    params = F.when(F.size("c.params") == n, F.col("c.params")).otherwise(F.raise_error(F.lit(f"the RGB camera lacks {n} parameters")))
    return first.where("c is not null").select("c.label", "c.model", params.alias("params"))


def read_frame_times(spark: SparkSession, path: str, fps: float | None = None) -> DataFrame:
    """file, stream, frame, t_sec of {"color": [us], "depth": [us]}; where a stamp is missing, the
    frame number (over fps where it is given)."""
    doc = _document(spark, path, "color array<long>, depth array<long>")
    parts = [doc.select("file", F.lit(s).alias("stream"), F.posexplode(f"d.{s}").alias("frame", "us")) for s in ("color", "depth")]
    fallback = F.col("frame") / F.lit(float(fps or 1.0))
    return parts[0].unionByName(parts[1]).select("file", "stream", "frame", F.coalesce(F.col("us") / 1e6, fallback).alias("t_sec"))


def unpack_arrays(df: DataFrame, keys: list[str], per_frame: list[str], per_cam: list[str] = ()) -> DataFrame:
    """keys..., frame and the entries of parallel arrays over frames; arrays over frames and
    cameras give cam as well."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(c) for c in [*per_frame, *per_cam]])).alias("frame", "_z")
    out = df.select(*keys, zipped).select(*keys, "frame", *[F.col(f"_z.{c}").alias(c) for c in [*per_frame, *per_cam]])
    if not per_cam:
        return out
    cams = F.posexplode(F.arrays_zip(*[F.col(c) for c in per_cam])).alias("cam", "_z")
    return out.select(*keys, "frame", *per_frame, cams).select(*keys, "frame", "cam", *per_frame, *[F.col(f"_z.{c}").alias(c) for c in per_cam])


def merge_camera_outputs(outputs: list[DataFrame], cameras: int, on=("seq", "frame")) -> DataFrame:
    """All cameras' rows as one table; a frame that some camera lacks is an error."""
    merged = reduce(lambda a, b: a.unionByName(b), outputs)
    n = F.size(F.collect_set("cam").over(Window.partitionBy(*on)))  # the cameras of one frame
    checked = F.when(n == cameras, F.col("cam")).otherwise(F.raise_error(F.lit("a camera lacks a frame")))
    return merged.withColumn("cam", checked)


def mask_catalogue(keys: DataFrame, column: str = "key", group: str = "group", seq: str = "seq") -> DataFrame:
    """frame_key, cam, role of keys <frame>-k<cam>.<role>.png; a group other than the sequence is
    an error."""
    pattern = r"^(.+)-k(\d+)\.(\w+)\.png$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    frame = F.when(F.col(group) == F.col(seq), part(1)).otherwise(F.raise_error(F.lit("a mask's group is not its sequence")))
    return keys.where(F.col(column).rlike(pattern)).select(seq, frame.alias("frame_key"), part(2).cast("int").alias("cam"), part(3).alias("role"))


def mask_to_runs(masks: DataFrame, by: list[str], counts: str = "counts", height: str = "height") -> DataFrame:
    """by..., v, u0, u1 of column-major run lengths that start with background: each foreground
    stretch is cut at the image's columns, and neighbouring columns' pixels of a row are joined."""
    from capture_tables.operators.masks import merge_runs

    spans = masks.select(*by, height, F.posexplode(counts).alias("_k", "_n"))
    w = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    on = spans.withColumn("_end", F.sum("_n").over(w)).where("_k % 2 = 1 and _n > 0").withColumn("_at", F.col("_end") - F.col("_n"))
    pixel = on.select(*by, height, F.explode(F.sequence(F.col("_at"), F.col("_end") - 1)).alias("_p"))
    v, u = (F.col("_p") % F.col(height)).cast("int"), F.floor(F.col("_p") / F.col(height)).cast("int")
    return merge_runs(pixel.select(*by, v.alias("v"), u.alias("u0"), (u + 1).alias("u1")), by)


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """point, cam, u, v, width, height of {"resolutions": {cam: [w, h]}, "points": {name: {cam:
    [u, v]}}}."""
    doc = _document(spark, path, "resolutions map<string,array<int>>, points map<string,map<string,array<double>>>")
    points = doc.select(F.explode("d.points").alias("point", "m"), "d.resolutions").select("point", "resolutions", F.explode("m").alias("cam", "uv"))
    return points.withColumn("s", F.try_element_at("resolutions", "cam")).select("point", "cam", F.col("uv")[0].alias("u"), F.col("uv")[1].alias("v"), F.col("s")[0].alias("width"), F.col("s")[1].alias("height"))


def read_seq_info(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The documents' fields by the schema, with the folder of each; fields whose names end in
    _path are resolved against it where they are relative."""
    rows = spark.read.schema(fields).json(path, multiLine=True).withColumn("folder", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    for name in [c for c in rows.columns if c.endswith("_path")]:
        rows = rows.withColumn(name, F.when(F.col(name).startswith("/"), F.col(name)).otherwise(F.concat_ws("/", "folder", name)))
    return rows


#: The name of a camera's file in the folder <seq>/<frame_key>.
FRAME_FILE = r"^k\d+\.(color|depth)\.\w+$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def complete_frames(files: DataFrame, cameras: int, need_depth: bool) -> DataFrame:
    """seq, frame_key of frame folders with all cameras' colour (and depth) files."""
    steps = files.select(F.split("path", "/").alias("_s"))
    part = lambda k: F.try_element_at("_s", F.lit(k))
    rows = steps.select(part(-3).alias("seq"), part(-2).alias("frame_key"), part(-1).alias("_f")).where("seq <> '' and frame_key <> ''").where(F.col("_f").rlike(FRAME_FILE))
    named = rows.select("seq", "frame_key", F.substring_index("_f", ".", 1).alias("cam"), F.split_part("_f", F.lit("."), F.lit(2)).alias("kind"))
    # a frame's files meet in one task, where each camera is one row before cameras are counted: two
    # distinct counts at once would hold every file twice
    has = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    cams = named.repartition("seq", "frame_key").groupBy("seq", "frame_key", "cam").agg(has("color").alias("_c"), has("depth").alias("_d"))
    out = cams.groupBy("seq", "frame_key").agg(F.sum("_c").alias("_c"), F.sum("_d").alias("_d"))
    keep = F.col("_c") == cameras
    return out.where(keep & (F.col("_d") == cameras) if need_depth else keep).select("seq", "frame_key")


def clip_inventory(frames: DataFrame, by: list[str], artefact: str, fps: float) -> DataFrame:
    """by..., artefact, frames, seconds, agrees: whether all artefacts of a take count alike."""
    n = frames.groupBy(*by, artefact).agg(F.count("*").alias("frames"))
    w = Window.partitionBy(*by)
    return n.withColumn("seconds", F.col("frames") / F.lit(fps)).withColumn("agrees", F.min("frames").over(w) == F.max("frames").over(w))


def pending_units(units: DataFrame, done: DataFrame, *inputs: DataFrame, on=("seq",)) -> DataFrame:
    """Units not done whose inputs all exist."""
    on = list(on)
    out = units.join(done.select(*on).distinct(), on, "left_anti")
    return reduce(lambda u, i: u.join(i.select(*on).distinct(), on, "left_semi"), inputs, out)




def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, failing on the first row that does not meet the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
