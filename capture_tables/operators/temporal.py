"""Runs, clips, chunks, gaps, differences and filters along the frames of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions.hashing import uniform


def along(by: list[str], order: str = "frame"):
    return Window.partitionBy(*by).orderBy(order)


def tracked_runs(df: DataFrame, condition: Column, gap: int = 0, by=("seq",)) -> DataFrame:
    """Runs of rows that meet the condition, bridging up to `gap` frames that do not: by...,
    lo, hi (both tracked frames), length = hi - lo + 1, tracked (rows in it)."""
    by = list(by)
    w = along(by)
    on = df.where(condition).select(*by, "frame")
    starts = on.withColumn("new", (F.col("frame") - F.lag("frame").over(w) > gap + 1).cast("int"))
    island = starts.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(w))
    return (
        island.groupBy(*by, "run")
        .agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("tracked"))
        .withColumn("length", (F.col("hi") - F.col("lo") + 1).cast("long"))
        .drop("run")
    )


def rank_runs(runs: DataFrame, by=("seq",)) -> DataFrame:
    """Runs with their rank by length, longest first, then the earlier."""
    w = Window.partitionBy(*by).orderBy(F.desc("length"), "lo")
    return runs.withColumn("rank", F.row_number().over(w))


def nth_run(runs: DataFrame, n: int, by=("seq",)) -> DataFrame:
    return rank_runs(runs, by).where(F.col("rank") == n).drop("rank")


def trim_to_run(df: DataFrame, condition: Column, gap: int = 0, rank: int = 1, by=("seq",)) -> DataFrame:
    """Rows of each sequence's run of that rank, renumbered from 0 in new_frame, with the run's
    coverage in %. A sequence without any run keeps its full take; a rank above the number of
    runs that a sequence has is an error."""
    by = list(by)
    runs = rank_runs(tracked_runs(df, condition, gap, by), by)
    chosen = runs.groupBy(*by).agg(
        F.max("rank").alias("_runs"),
        F.max(F.when(F.col("rank") == rank, F.struct("lo", "hi", "tracked", "length"))).alias("_run"),
    )
    joined = df.join(chosen, by, "left")
    lo = F.coalesce(F.col("_run.lo"), F.min("frame").over(Window.partitionBy(*by)))
    checked = F.when(
        F.col("_runs") < rank, F.raise_error(F.lit(f"a sequence has fewer than {rank} runs"))
    ).otherwise(F.col("frame") - lo)
    return (
        joined.where(F.col("_run").isNull() | F.col("frame").between(F.col("_run.lo"), F.col("_run.hi")))
        .withColumn("new_frame", checked.cast("int"))
        .withColumn("coverage", F.col("_run.tracked") * 100.0 / F.col("_run.length"))
        .drop("_run", "_runs")
    )


def sliding_clips(df: DataFrame, length: int, stride: int, by=("seq",)) -> DataFrame:
    """Every row once for each clip that holds it: clip = its first frame, pos in it. Clips
    start at frame 0, then every `stride`, and have full length; frames count from 0."""
    by = list(by)
    last = F.max("frame").over(Window.partitionBy(*by)) - (length - 1)
    first = F.greatest(F.ceil((F.col("frame") - (length - 1)) / F.lit(float(stride))).cast("int"), F.lit(0))
    until = F.least(F.floor(F.col("frame") / F.lit(stride)), F.floor(F.col("_last") / F.lit(stride))).cast("int")
    return (
        df.withColumn("_last", last)
        .withColumn("_first", first)
        .withColumn("_until", until)
        .where("_last >= 0 and _until >= _first")
        .withColumn("clip", F.explode(F.transform(F.sequence("_first", "_until"), lambda k: k * F.lit(stride))))
        .withColumn("pos", F.col("frame") - F.col("clip"))
        .drop("_last", "_first", "_until")
    )


def filter_clips(clips: DataFrame, value: str, rule: str, threshold: float, chance: float = 1.0, seed: int = 0, by=("seq",)) -> DataFrame:
    """Rows of the clips that a rule keeps. drop-occ: none of its frames has a value below the
    threshold. mixed: clips with all values at or over it go with probability `chance`.
    fp-error: clips with a mean below it go with probability `chance`."""
    # in order of the frames: a mean at the threshold is above or below it by the order of its sum
    w = along([*by, "clip"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, mean = F.min(value).over(w), F.avg(value).over(w)
    goes = {"drop-occ": low < threshold, "mixed": low >= threshold, "fp-error": mean < threshold}[rule]
    if rule != "drop-occ" and chance < 1.0:
        goes = goes & (uniform(seed, *by, "clip") < chance)
    return clips.withColumn("_goes", goes).where(~F.coalesce("_goes", F.lit(False))).drop("_goes")


def chunks(df: DataFrame, length: int) -> DataFrame:
    """Contiguous chunks of `length` frames; the short tail is a chunk too."""
    return df.withColumn("chunk", F.floor(F.col("frame") / F.lit(length)).cast("int"))


def differences(df: DataFrame, names: list[str], order: int = 2, by=("seq",)) -> DataFrame:
    """d<order>_<name>: the forward difference of that order, NULL where a frame is missing at
    the end; and step, the length of the first difference over all names."""
    w = along(list(by))
    signs = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[order]
    for n in names:
        terms = [F.lead(n, order - k).over(w) * float(c) for k, c in enumerate(signs)]
        df = df.withColumn(f"d{order}_{n}", sum(terms[1:], terms[0]))
    square = sum((F.pow(F.lead(n, 1).over(w) - F.col(n), 2) for n in names[1:]), F.pow(F.lead(names[0], 1).over(w) - F.col(names[0]), 2))
    return df.withColumn("step", F.sqrt(square))


def static_mask(df: DataFrame, contact: Column, width: int = 5, by=("seq",)) -> DataFrame:
    """static: 1 where no frame within width // 2 has contact."""
    half = width // 2
    w = along(list(by)).rowsBetween(-half, half)
    return df.withColumn("static", (1 - F.max(contact.cast("int")).over(w)).cast("int"))


def forward_fill_mask(df: DataFrame, area: str, least: int = 20, chunk: int = 120, by=("seq",)) -> DataFrame:
    """source_frame: the frame itself, or the most recent before it in its chunk, whose mask
    has `least` pixels; NULL where there is none."""
    w = along([*by, "_chunk"]).rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.col(area) >= least, F.col("frame"))
    return (
        df.withColumn("_chunk", F.floor(F.col("frame") / F.lit(chunk)))
        .withColumn("source_frame", F.last(good, ignorenulls=True).over(w))
        .drop("_chunk")
    )


def visibility_gap(df: DataFrame, visible: str, threshold: float, omega: float, clock: str = "frames", fps: float = 30.0, base: float = 13.0, by=("seq",)) -> DataFrame:
    """gap since the last visible row before this one, in frames or seconds (of column t_sec),
    and gate = base + gap * omega degrees (* fps for seconds); NULL before any was visible."""
    at = {"frames": "frame", "seconds": "t_sec"}[clock]
    w = along(list(by)).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(visible) > threshold, F.col(at)), ignorenulls=True).over(w)
    scale = omega if clock == "frames" else omega * fps
    return df.withColumn("gap", F.col(at) - last).withColumn("gate", base + F.col("gap") * scale)


def split_sequences(df: DataFrame, by=("seq",)) -> DataFrame:
    """Each sequence's own rows numbered from 0 in pos, with its first and last frame."""
    w = Window.partitionBy(*by)
    return (
        df.withColumn("pos", F.row_number().over(w.orderBy("frame")) - 1)
        .withColumn("first_frame", F.min("frame").over(w))
        .withColumn("last_frame", F.max("frame").over(w))
    )


def timeline(df: DataFrame, condition: Column, width: int, by=("seq",)) -> DataFrame:
    """by..., bucket (0 to width - 1), green: true if every frame of the bucket meets the
    condition. Bucket i of n frames covers [floor(i n / w), max(lo + 1, floor((i + 1) n / w)))."""
    by = list(by)
    sized = df.select(*by, "frame", condition.alias("_on"), (F.max("frame").over(Window.partitionBy(*by)) + 1).alias("_n"))
    # the buckets that can hold a frame lie around frame * width / n
    guess = F.floor(F.col("frame") * width / F.col("_n"))
    lo = F.floor(F.col("bucket") * F.col("_n") / width)
    hi = F.greatest(lo + 1, F.floor((F.col("bucket") + 1) * F.col("_n") / width))
    spread = F.ceil(F.lit(width) / F.col("_n")) + 1
    held = sized.withColumn(
        "bucket", F.explode(F.sequence(F.greatest(guess - spread, F.lit(0)), F.least(guess + spread, F.lit(width - 1))))
    ).where((F.col("frame") >= lo) & (F.col("frame") < hi))
    return held.groupBy(*by, F.col("bucket").cast("int").alias("bucket")).agg(F.bool_and("_on").alias("green"))


def thin(df: DataFrame, most: int, by=("seq",)) -> DataFrame:
    """Every k-th row, k = max(1, n // most), from the first."""
    w = Window.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / F.lit(most)))
    return (
        df.withColumn("_k", F.row_number().over(w.orderBy("frame")) - 1)
        .withColumn("_step", step)
        .where("_k % _step = 0")
        .drop("_k", "_step")
    )


def missing_frames(track: DataFrame, lo: int, hi: int, by=("seq",)) -> DataFrame:
    """Frames of [lo, hi], within what a track covers, that it lacks."""
    by = list(by)
    span = track.groupBy(*by).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    first, last = F.greatest("a", F.lit(lo)), F.least("b", F.lit(hi))
    wanted = span.where(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("frame"))
    return wanted.join(track.select(*by, "frame"), [*by, "frame"], "left_anti")


def reverse_clips(clips: DataFrame, chance: float = 0.5, seed: int = 0, by=("seq",)) -> DataFrame:
    """Clips turned round in time under a coin that follows from the clip's key: pos becomes
    length - 1 - pos, reversed says so."""
    w = Window.partitionBy(*by, "clip")
    coin = uniform(seed, *by, "clip") < chance
    return clips.withColumn("reversed", coin).withColumn(
        "pos", F.when(F.col("reversed"), F.max("pos").over(w) - F.col("pos")).otherwise(F.col("pos")).cast("int")
    )


def offset_margin(scores: DataFrame, by=(), apart: int = 2, warn_below: float = 25.0) -> DataFrame:
    """best_offset (lowest score, then lowest offset), rival_offset more than `apart` away,
    margin in % of the best score's shortfall, ambiguous where it is below `warn_below`."""
    by = list(by)
    best = scores.groupBy(*by).agg(F.min(F.struct("score", "offset")).alias("b")).select(*by, F.col("b.score").alias("best_score"), F.col("b.offset").alias("best_offset"))
    joined = scores.join(best, by) if by else scores.join(F.broadcast(best))  # one row
    rival = F.min(F.when(F.abs(F.col("offset") - F.col("best_offset")) > apart, F.struct("score", "offset")))
    margin = (F.col("r.score") - F.col("best_score")) / F.col("r.score") * 100.0
    return (
        joined.groupBy(*by, "best_offset", "best_score")
        .agg(rival.alias("r"))
        .select(*by, "best_offset", "best_score", F.col("r.offset").alias("rival_offset"), margin.alias("margin"))
        .withColumn("ambiguous", F.col("margin") < warn_below)
    )


def registration_frames(df: DataFrame, every: int, by=("seq",)) -> DataFrame:
    """register: true on a sequence's first frame and every `every` frames after it."""
    k = F.row_number().over(along(list(by))) - 1
    return df.withColumn("register", k % every == 0)
