"""Structured Streaming forms of the frame checks. All take and give streaming DataFrames with an
event time column `ts`, and hold state only within their watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from capture_tables.functions import linalg as la
from capture_tables.operators import masks
from capture_tables.operators.filters import alpha
from capture_tables.operators.grouped import schema_of


def read_frames(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    """A stream over Parquet files as they arrive; ts without zone is taken as the session's."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(frames: DataFrame, late: str, keys=("seq", "cam", "frame")) -> DataFrame:
    """Each frame once; frames later than the watermark are dropped."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def quality_windows(frames: DataFrame, late: str, width: str = "10 seconds", by=("seq",)) -> DataFrame:
    """Tumbling windows: frames, percentage tracked, mean residual and approximate median ratio."""
    w = F.window("ts", width)
    return frames.withWatermark("ts", late).groupBy(*by, w).agg(
        F.count("*").alias("frames"),
        (F.avg(F.col("tracked").cast("double")) * 100.0).alias("tracked_pct"),
        F.avg("residual").alias("mean_residual"),
        F.percentile_approx("ratio", 0.5, 10000).alias("median_ratio"),
    )


def sliding_meters(frames: DataFrame, late: str, width: str = "20 seconds", slide: str = "1 second", by=("seq",)) -> DataFrame:
    """Sliding windows: count, mean and largest value."""
    return frames.withWatermark("ts", late).groupBy(*by, F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.avg("value").alias("avg"), F.max("value").alias("max"))


def tracked_sessions(frames: DataFrame, late: str, gap: str, by=("seq",)) -> DataFrame:
    """Tracked runs as session windows: a gap of that length ends a run."""
    on = frames.withWatermark("ts", late).where("tracked")
    return on.groupBy(*by, F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("tracked"))


#: Buckets of groups: those of one bucket share a state, so that a call and a state's way to Python and
#: back are paid for a bucket, not for each group. The number stays as it is over a stream's restarts.
BUCKETS = 256
Step = Callable[[pd.DataFrame | None, pd.DataFrame | None, int], tuple[pd.DataFrame | None, pd.DataFrame]]


def _in_buckets(frames: DataFrame, by: list[str], step: Step, schema: str) -> DataFrame:
    """`frames` through a step with states for each bucket of groups, in event time: a bucket's groups are one
    table, with a time `due` for each row. `step` gets the new rows, or None when a due time has passed, the
    table, or None, and the watermark in milliseconds; it gives what comes out, and the new table. A state
    comes and goes with its rows: states that are asked for one by one (transformWithState) cost a wait each."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = None if state.hasTimedOut else pd.concat(list(parts), ignore_index=True), state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else None
        out, held = step(rows, held, now)
        if len(held):
            table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(held["due"].min()), now + 1))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    bucketed = frames.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    return bucketed.groupBy("_bucket").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _grouped(held: pd.DataFrame | None, rows: pd.DataFrame, by: list[str], order: list[str]) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
    """The rows by group, each in its order, the number of each row's group, and the groups: those of the
    table first."""
    rows = rows.sort_values(order, ignore_index=True)
    keys = rows[by] if held is None else pd.concat([held[by], rows[by]], ignore_index=True)
    number = keys.groupby(by, sort=False, dropna=False).ngroup().to_numpy()[-len(rows) :]
    turn = np.argsort(number, kind="stable")
    return rows.iloc[turn].reset_index(drop=True), number[turn], keys.drop_duplicates(ignore_index=True)


def _carried(held: pd.DataFrame | None, n: int, name: str, fill) -> np.ndarray:
    """A column of the table for n groups, `fill` for new ones."""
    out = np.full(n, fill)
    if held is not None:
        out[: len(held)] = held[name]
    return out


def _flat(lists, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` numbers out of lists that may be null, and the place of each row's list."""
    sizes = np.array([0 if x is None else len(x) // width for x in lists], np.int64)
    rows = [np.asarray(x, np.int64) for x in lists if x is not None]
    return np.concatenate([np.empty(0, np.int64), *rows]).reshape(-1, width), np.repeat(np.arange(len(sizes)), sizes)


def _waiting(held: pd.DataFrame, now: int) -> pd.DataFrame:
    return held[held["due"] > now]


def smoothed(frames: DataFrame, column: str, least_cutoff: float = 1.0, beta: float = 0.1, speed_cutoff: float = 1.0, late: str = "10 minutes", idle: float = 86400.0) -> DataFrame:
    """seq, event_id, ts, smooth: causal one-euro filtering of each track; the state is three
    numbers for each track, forgotten `idle` seconds behind its last event: the filter then
    starts anew. Events later than the watermark are dropped."""

    def step(rows, held, now):
        if rows is None:
            return None, _waiting(held, now)
        rows, at, groups = _grouped(held, rows, ["seq"], ["micros", "event_id"])
        value, speed, time = (_carried(held, len(groups), c, np.nan) for c in ("value", "speed", "time"))
        known, due = np.arange(len(groups)) < (0 if held is None else len(held)), _carried(held, len(groups), "due", 0)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        length, x, t = np.diff(np.append(starts, len(at))), rows["x"].to_numpy(float), rows["micros"].to_numpy() / 1e6
        out = np.empty(len(rows))
        # all tracks take their k-th step together
        for k in range(int(length.max())):
            i = starts[length > k] + k
            g = at[i]
            dt = np.maximum(t[i] - time[g], 1e-9)
            a = alpha(speed_cutoff, dt)
            fast = a * (x[i] - value[g]) / dt + (1 - a) * speed[g]
            b = alpha(least_cutoff + beta * np.abs(fast), dt)
            value[g] = np.where(known[g], b * x[i] + (1 - b) * value[g], x[i])
            speed[g], time[g], known[g] = np.where(known[g], fast, 0.0), t[i], True
            out[i] = value[g]
        own = at[starts]
        last = rows["micros"].to_numpy()[starts + length - 1]
        due[own] = np.maximum(last // 1000 + int(idle * 1000), now + 1)
        kept = groups.assign(value=value, speed=speed, time=time, due=due)
        return rows[["seq", "event_id", "ts"]].assign(smooth=out), _waiting(kept, now)

    picked = frames.withWatermark("ts", late).select("seq", "event_id", "ts", F.unix_micros("ts").alias("micros"), F.col(column).cast("double").alias("x"))
    return _in_buckets(picked, ["seq"], step, "seq long, event_id long, ts timestamp, smooth double")


def visibility_gate(frames: DataFrame, threshold: float, omega: float, base: float = 13.0, fps: float = 30.0, d: int = 15, late: str = "10 minutes", idle: float = 86400.0) -> DataFrame:
    """seq, event_id, gap (seconds since the last visible frame), gate (degrees), instance, chosen_by:
    of a frame's masks (`candidates`, an array of instance, v, u0, u1) the one that overlaps the mask
    chosen before most, else the dilated `person` (an array of v, u0, u1), else the largest, as
    `masks.chained_instances` with chunks of one frame. The state of a track is its last visible time
    and its last mask's runs, forgotten `idle` seconds behind its last event. Events later than the
    watermark are dropped."""

    def step(rows, held, now):
        if rows is None:
            return None, _waiting(held, now)
        rows, at, groups = _grouped(held, rows, ["seq"], ["micros", "event_id"])
        seen, due = _carried(held, len(groups), "seen", np.nan), _carried(held, len(groups), "due", 0)
        seconds = rows["micros"] / 1e6
        first = pd.Series(seen[at])
        last = seconds.where(rows["vis"] > threshold).groupby(at).ffill().fillna(first)
        before = last.groupby(at).shift().where(at == np.roll(at, 1), first) if len(rows) > 1 else first
        before[:1] = first[:1]
        # a track's mask from before is a frame of its own ahead of the others
        old, kept_at = _flat([] if held is None else held["mask"], 3)
        new, own = _flat(rows["candidates"], 4)
        had, has = np.unique(kept_at), np.unique(own)
        order = np.argsort(np.concatenate([had, at[has]]), kind="stable")
        number = np.argsort(order, kind="stable")
        runs = np.concatenate([np.insert(old, 0, 0, axis=1), new])
        frame = np.concatenate([number[np.searchsorted(had, kept_at)], number[len(had) + np.searchsorted(has, own)]])
        turn = np.argsort(frame, kind="stable")
        person, person_at = _flat(rows["person"], 3)
        met = np.isin(person_at, has)
        instance, how, mask = np.full(len(rows), -1), np.full(len(rows), 3), [np.empty(0, np.int64)] * len(groups)
        if len(order):
            track = np.concatenate([had, at[has]])[order]
            pick, by_what, taken = masks.choose_instances(runs[turn], frame[turn], person[met], number[len(had) + np.searchsorted(has, person_at[met])], track, d)
            instance[has], how[has] = pick[number[len(had) :]], by_what[number[len(had) :]]
            ends = np.flatnonzero(np.diff(track, append=-1))
            last_runs = taken & np.isin(frame[turn], ends)
            of = track[frame[turn][last_runs]]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for g, part in zip(of[np.append(0, cuts)].tolist(), np.split(runs[turn][last_runs][:, 1:], cuts), strict=True):
                mask[g] = part.ravel()
        seen[at] = last  # of a group's rows the last one stays
        due[at] = rows["micros"].to_numpy() // 1000 + int(idle * 1000)
        kept = groups.assign(seen=seen, mask=mask, due=due)
        out = rows[["seq", "event_id"]].assign(gap=(seconds - before).astype("Float64"), instance=pd.array(instance, "Int64"), chosen_by=np.array(["previous", "person", "largest", None], object)[how])
        out.loc[how == 3, "instance"] = pd.NA
        return out, _waiting(kept, now)

    # arrays of numbers come to Python at once, arrays of structs value by value
    numbers = lambda name, *fields: F.flatten(F.transform(name, lambda r: F.array(*[r[f].cast("long") for f in fields]))).alias(name)
    picked = frames.withWatermark("ts", late).select("seq", "event_id", "ts", F.unix_micros("ts").alias("micros"), F.col("vis").cast("double").alias("vis"), numbers("candidates", "instance", "v", "u0", "u1"), numbers("person", "v", "u0", "u1"))
    out = _in_buckets(picked, ["seq"], step, "seq long, event_id long, gap double, instance long, chosen_by string")
    return out.withColumn("gate", base + F.col("gap") * fps * omega)


def paired(colour: DataFrame, depth: DataFrame, within: float, late: str) -> DataFrame:
    """seq, colour_id, depth_id, apart: each colour frame with the depth frame of its sequence that is
    nearest in time, ties to the earlier, if it is at most `within` seconds away; apart is how many
    seconds later it is. A pair comes out once the watermark tells that nothing nearer can come; until
    then both sides wait as states. Sides have event_id and ts."""
    near = round(within * 1e6)

    def step(rows, held, now):
        """Pair the colour frames that nothing nearer can come for, and let go what none can take."""
        reached, names = now * 1000, ["seq", "micros", "event_id", "colour"]
        both = pd.concat([df[names] for df in (held, rows) if df is not None], ignore_index=True).sort_values(["micros", "event_id"], ignore_index=True)
        both["group"] = both.groupby("seq", sort=False, dropna=False).ngroup()
        asks, gives = both[both["colour"]], both[~both["colour"]]
        done = asks["micros"] + near <= reached
        settled, waiting, out = asks[done], asks[~done], None
        if len(settled) and len(gives):
            places = gives.drop_duplicates(["group", "micros"])[["group", "micros", "event_id"]].assign(at=lambda p: p["micros"])
            before, after = (pd.merge_asof(settled, places.rename(columns={"event_id": "depth_id"}), on="micros", by="group", direction=way, tolerance=near) for way in ("backward", "forward"))
            ahead = (after["at"] - after["micros"]).fillna(np.inf) < (before["micros"] - before["at"]).fillna(np.inf)
            best = before.where(~ahead, after)
            best = best[best["at"].notna()]
            out = pd.DataFrame({"seq": best["seq"], "colour_id": best["event_id"], "depth_id": best["depth_id"].astype("int64"), "apart": (best["at"] - best["micros"]) / 1e6})
        since = gives["group"].map(waiting.groupby("group")["micros"].min()).fillna(reached).clip(upper=reached) - near
        kept = pd.concat([waiting, gives[gives["micros"] >= since]])
        return out, kept[names].assign(due=-(-(kept["micros"] + near) // 1000) - 1)

    sides = [df.withWatermark("ts", late).select("seq", "event_id", "ts", F.unix_micros("ts").alias("micros"), F.lit(side).alias("colour")) for df, side in ((colour, True), (depth, False))]
    return _in_buckets(sides[0].unionByName(sides[1]), ["seq"], step, "seq long, colour_id long, depth_id long, apart double")


def with_calibration(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """A stream joined with the static camera table."""
    return frames.join(cameras, "cam")


_SUMS = [f"a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"b{i}" for i in range(3)]


def live_triangulation(rays: DataFrame, late: str, hold: float, by=("seq", "frame")) -> DataFrame:
    """by..., ts, x, y, z, n_views of rays (cam, ts, ox .. dz): a frame comes out as soon as a second
    camera sees it, once, from the rays up to this one in order of time; n_views counts them. Frames
    that one camera alone sees never come out. The state of a frame is nine sums; it goes, and with it
    the memory that the frame is done, `hold` seconds behind its last ray."""
    by = list(by)
    d, o = la.columns("dx", "dy", "dz"), la.columns("ox", "oy", "oz")
    p = [[F.lit(1.0 if i == j else 0.0) - d[i] * d[j] for j in range(3)] for i in range(3)]
    parts = [p[i][j].alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)] + [la.dot(p[i], o).alias(f"b{i}") for i in range(3)]
    picked = rays.withWatermark("ts", late).select(*by, F.col("cam").cast("int").alias("cam"), "ts", F.unix_micros("ts").alias("micros"), *parts)
    schema = schema_of(picked, by) + ", micros long, n_views long, " + ", ".join(f"{c} double" for c in _SUMS)

    def step(rows, held, now):
        """Sums of a frame's rays until a second camera sees it, then only that it is done."""
        if rows is None:
            return None, _waiting(held, now)
        rows, at, groups = _grouped(held, rows, by, ["micros", "cam"])
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        own, size = at[starts], np.diff(np.append(starts, len(at)))
        camera, n, done, due = (_carried(held, len(groups), c, fill) for c, fill in (("cam", 0), ("n_views", 0), ("done", False), ("due", 0)))
        fresh = own[own >= (0 if held is None else len(held))]
        camera[fresh] = rows["cam"].to_numpy()[starts[np.isin(own, fresh)]]
        other = np.where(rows["cam"].to_numpy() != camera[at], np.arange(len(rows)), len(rows))
        second = np.minimum.reduceat(other, starts)
        used = (np.arange(len(rows)) <= np.repeat(second, size)) & ~done[at]
        n[own] += np.add.reduceat(used.astype(np.int64), starts)
        sums = {}
        for c in _SUMS:
            sums[c] = _carried(held, len(groups), c, 0.0)
            sums[c][own] += np.add.reduceat(np.where(used, rows[c].to_numpy(float), 0.0), starts)
        micros, still = rows["micros"].to_numpy(), ~done[own]
        due[own[still]] = np.maximum(micros[starts + size - 1] // 1000, now)[still] + int(hold * 1000)
        seen = still & (second < len(rows))
        done[own[seen]] = True
        out = groups.iloc[own[seen]].assign(micros=micros[second[seen]], n_views=n[own[seen]], **{c: v[own[seen]] for c, v in sums.items()})
        return out, _waiting(groups.assign(cam=camera, n_views=n, done=done, **sums, due=due), now)

    out = _in_buckets(picked, by, step, schema)
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    x = la.solve(a, la.columns("b0", "b1", "b2"))
    return out.select(*by, F.timestamp_micros("micros").alias("ts"), *[c.alias(n) for c, n in zip(x, "xyz", strict=True)], "n_views")


def write_frames(frames: DataFrame, path: str, mode: str = "append", partitions: int | None = None):
    """Start a restartable Parquet sink that takes what is there and stops: the checkpoint lies
    beside the data. States lie in `partitions` parts, or the session's number of shuffle partitions, from
    the first start on: each costs a task and files of its own in every batch."""
    conf = frames.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(partitions or before))
    try:  # a stream keeps the settings of its start
        return frames.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose manifests stand, oldest first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()) if files.exists(at) else []


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Each partition's value and the batch that wrote its present rows; as many rows as partitions."""
    return spark.read.parquet(f"{path}/manifests/{version}")


def read_upserted(spark: SparkSession, path: str, schema, partition: str, version: int | None = None) -> DataFrame:
    """The table that upsert_frames keeps, as its newest batch left it, or an older one."""
    found = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    at = _manifest(spark, path, found[-1] if version is None else version)
    kind = schema[partition].dataType
    whole = StructType([*[f for f in schema if f.name != partition], StructField("_batch", LongType()), StructField(partition, kind)])
    # folders that a manifest names, as many as partitions at most: what a batch left unfinished is not even listed
    folders = [f"{path}/data/_batch={r[0]}" for r in at.select("_batch").distinct().collect()]
    kept = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders)
    return kept.join(F.broadcast(at), ["_batch", partition], "left_semi").select(*schema.names)


def upsert_frames(frames: DataFrame, path: str, keys: list[str], partition: str, between=None):
    """Each micro-batch replaces the rows of its keys: the partitions that it touches are written anew
    below data/_batch=<number>, next to the old ones, and then a manifest that names each partition's
    folder is moved into place in one step. Until then readers see what was there before, and a batch
    that is run again after a crash starts from it; a batch whose manifest stands is left alone. A key
    that comes twice in a batch keeps both rows. `between` is called before the manifest is moved."""
    spark, schema = frames.sparkSession, frames.schema

    def merge(batch: DataFrame, number: int) -> None:
        found = _versions(spark, path)
        if (found and found[-1] >= number) or batch.isEmpty():
            return
        touched = batch.select(partition).distinct()
        merged = batch
        if found:
            old = read_upserted(spark, path, schema, partition).join(touched, partition, "left_semi")
            merged = old.join(batch.select(*keys).distinct(), keys, "left_anti").select(*batch.columns).unionByName(batch)
        merged.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/data/_batch={number}")
        at = touched.withColumn("_batch", F.lit(number).cast("long"))
        if found:
            at = _manifest(spark, path, found[-1]).join(touched, partition, "left_anti").select(*at.columns).unionByName(at)
        at.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/next-{number}")
        if between:
            between(number)
        jvm = spark.sparkContext._jvm
        staged, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}") for name in (f"next-{number}", str(number)))
        if not staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, final):
            raise OSError(f"the manifest of batch {number} could not be moved into place")

    return frames.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
