"""Streams with states of their own, upserts that a crash interrupts, chosen masks and long sequences,
against plain Python."""

import contextlib
import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_tables.functions.shared import shared_path
from capture_tables.operators import geometry, joins, masks, ranges, temporal
from capture_tables.operators.filters import OneEuro
from capture_tables.streaming import frames as s

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def arriving(spark, schema, *files):
    """A stream that gets one file after the other."""
    path = shared_path(spark, "arriving")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return s.read_frames(spark, path, spark.createDataFrame([], schema).schema)


def result(stream):
    path = shared_path(stream.sparkSession, "out")
    s.write_frames(stream, path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data").collect()


def test_pairs_are_the_nearest_and_ties_the_earlier(spark):
    schema = "seq long, event_id long, ts timestamp"
    colour = arriving(spark, schema, [(1, 10, at(10.0)), (1, 11, at(20.0))], [(1, 12, at(50.0)), (2, 13, at(10.0))], [(1, 99, at(500.0)), (2, 98, at(500.0))])
    depth = arriving(spark, schema, [(1, 20, at(8.0)), (1, 21, at(12.0))], [(1, 22, at(21.0)), (1, 24, at(50.0)), (1, 23, at(50.0)), (2, 25, at(13.1))], [(1, 97, at(500.0))])
    found = sorted((r.seq, r.colour_id, r.depth_id, round(r.apart, 3)) for r in result(s.paired(colour, depth, 3.0, "30 seconds")))
    # 13 has no depth frame within three seconds; 99 and 98 still wait
    assert found == [(1, 10, 20, -2.0), (1, 11, 22, 1.0), (1, 12, 23, 0.0)]


def test_a_frame_comes_out_at_its_second_camera_and_once(spark):
    schema = "seq long, frame long, cam int, ts timestamp, ox double, oy double, oz double, dx double, dy double, dz double"
    ray = lambda frame, cam, t, o, d: (1, frame, cam, at(t), *map(float, o), *map(float, d))
    first = [ray(1, 0, 1, (0, 0, 0), (0, 0, 1)), ray(2, 0, 2, (0, 0, 0), (0, 0, 1)), ray(2, 0, 2.5, (0, 0, 0), (0, 0, 1))]
    second = [ray(1, 1, 3, (-5, 0, 5), (1, 0, 0)), ray(1, 2, 4, (9, 9, 9), (0, 1, 0)), ray(3, 5, 4, (0, 0, 0), (1, 0, 0))]
    third = [ray(1, 1, 5, (-5, 0, 7), (1, 0, 0)), ray(2, 1, 6, (0, -3, 4), (0, 1, 0))]
    found = result(s.live_triangulation(arriving(spark, schema, first, second, third), "1 hour", 86400.0))
    # all of it is within the watermark's hour, frame 3 has one camera alone
    assert sorted((r.frame, round(r.x, 6), round(r.y, 6), round(r.z, 6), r.n_views) for r in found) == [(1, 0.0, 0.0, 5.0, 2), (2, 0.0, 0.0, 4.0, 3)]


def random_masks(r, frames, least=0):
    runs = lambda: [(v, u, u + r.randint(1, 6)) for v in r.sample(range(4), r.randint(1, 3)) for u in [r.randint(0, 25)]]
    return {f: {k: runs() for k in range(r.randint(least, 3))} for f in range(frames)}, {f: runs() for f in range(frames) if r.random() < 0.5}


def pixels(runs, d=0):
    return {(v + dv, u) for v, u0, u1 in runs for u in range(u0 - d, u1 + d) for dv in range(-d, d + 1)}


def plain_chain(found, person, chunk, d):
    """Each chunk's choice, by sets of pixels."""
    out, previous = {}, set()
    for start in range(0, max(found) + 1, chunk):
        candidates = {k: pixels(runs) for k, runs in found.get(start, {}).items()}
        if not candidates:
            continue
        for how, other in (("previous", previous), ("person", pixels(person.get(start, []), d)), ("largest", set().union(*candidates.values()))):
            size = {k: len(p & other) for k, p in sorted(candidates.items())}
            pick = max(size, key=size.get)
            if size[pick]:
                break
        out[start // chunk] = (pick, how)
        for f in range(start, start + chunk):
            if pick in found.get(f, {}):
                previous = pixels(found[f][pick])
    return out


@pytest.mark.parametrize("chunk", [1, 4])
def test_chosen_masks_are_carried_on(spark, chunk):
    r = random.Random(chunk)
    takes = {seq: random_masks(r, 40) for seq in range(5)}
    runs = [(seq, f, k, *x) for seq, (found, _) in takes.items() for f, own in found.items() for k, rs in own.items() for x in rs]
    people = [(seq, f, *x) for seq, (_, person) in takes.items() for f, rs in person.items() for x in rs]
    cands = spark.createDataFrame(runs, "seq int, frame int, instance int, v int, u0 int, u1 int")
    chosen = masks.chained_instances(cands, spark.createDataFrame(people, "seq int, frame int, v int, u0 int, u1 int"), chunk, 2).collect()
    for seq, (found, person) in takes.items():
        wanted = plain_chain(found, person, chunk, 2)
        assert {x.chunk: (x.instance, x.chosen_by) for x in chosen if x.seq == seq} == wanted
        if chunk == 1:  # the stream's step says the same
            state = []
            for f in range(40):
                named = [dict(zip(("instance", "v", "u0", "u1"), (k, *x), strict=True)) for k, rs in found[f].items() for x in rs]
                pick, how, state = masks.choose_instance(named, state, [dict(zip(("v", "u0", "u1"), x, strict=True)) for x in person.get(f, [])], 2)
                assert (pick, how) == wanted.get(f, (None, None))


def test_upserts_survive_a_crash_between_their_steps(spark):
    """The batch that fails before its manifest is moved leaves the old rows whole; it runs again after
    a restart, and once more, when Spark has lost that it was done, without a second effect."""
    schema = "part int, id long, x long, ts timestamp"
    batches = [[(k % 3, k, 0, START) for k in range(9)], [(k % 3, k, 1, START) for k in (0, 1, 10)], [(2, 2, 2, START)]]
    stream = arriving(spark, schema, *batches).select("part", "id", "x")
    path = shared_path(spark, "upserted").removeprefix("file://")
    rows = lambda: {x.id: (x.part, x.x) for x in s.read_upserted(spark, path, stream.schema, "part").collect()}

    def fails(number):
        if number == 1:
            raise RuntimeError("lost between the steps")

    with pytest.raises(Exception, match="lost between"):
        s.upsert_frames(stream, path, ["id"], "part", fails).awaitTermination()
    assert rows() == {k: (k % 3, 0) for k in range(9)}
    s.upsert_frames(stream, path, ["id"], "part").awaitTermination()
    wanted = {k: (k % 3, 0) for k in range(9)} | {0: (0, 1), 1: (1, 1), 10: (1, 1), 2: (2, 2)}
    assert rows() == wanted and s._versions(spark, path) == [0, 1, 2]
    assert {x.id for x in s.read_upserted(spark, path, stream.schema, "part", 0).collect()} == set(range(9))
    written = sorted(os.listdir(f"{path}/data"))
    for name in ("2", ".2.crc"):
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{path}/checkpoint/commits/{name}")
    s.upsert_frames(stream, path, ["id"], "part").awaitTermination()
    assert rows() == wanted and sorted(os.listdir(f"{path}/data")) == written


def test_long_sequences_in_ranges_equal_the_plain_operators(spark):
    """Two sequences over all partitions of a sort, also with gaps wider than a range."""
    r = random.Random(5)
    rows = [(seq, f, r.random() < 0.7) for seq in (1, 2) for f in sorted(r.sample(range(1500), 700)) if not 400 < f < 900 or seq == 1]
    df = spark.createDataFrame(rows, "seq int, frame int, tracked boolean").repartition(4)
    ranged = ranges.in_ranges(df, ["seq"], ["frame"])
    spread = ranged.groupBy("seq").agg(F.count_distinct("_range")).collect()
    assert len(spread) == 2 and all(x[1] >= 2 for x in spread) or ranged.select("_range").distinct().count() == 1
    for gap in (0, 3):
        one, two = ranges.tracked_runs(df, F.col("tracked"), gap), temporal.tracked_runs(df, F.col("tracked"), gap)
        assert sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect()))
    left = df.where("frame % 3 = 0").select("seq", F.col("frame").cast("double").alias("t"), F.col("frame").alias("own"))
    right = df.where("tracked and frame % 5 = 1").select("seq", (F.col("frame") + 0.5).alias("t"), F.col("frame").alias("other"))
    one, two = (f(left, right, ["seq"], "t", "other", 7.0) for f in (ranges.join_nearest, joins.join_nearest))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    last = {(x.seq, x.frame): x.source_frame for x in ranges.last_where(df, F.col("tracked"), "frame").collect()}
    for seq in (1, 2):
        seen = None
        for _, f, tracked in sorted(x for x in rows if x[0] == seq):
            seen = f if tracked else seen
            assert last[seq, f] == seen


def test_combinations_beyond_the_cap_fall_back_to_the_first(spark):
    cameras = spark.createDataFrame([(c, 1024, 768, 900.0, 900.0, 512.0, 384.0, *map(float, (1, 0, 0, 0, 1, 0, 0, 0, 1)), -float(c), 0.0, 0.0) for c in range(3)],
        "cam int, width int, height int, fx double, fy double, cx double, cy double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")
    seen = lambda c, k: (1, c, k, 512.0 + 900 * (0.3 - c) / 6 + 40 * (k != 1), 384.0 + 15 * (k != 1))
    obs = spark.createDataFrame([seen(c, k) for c in range(3) for k in range(3)], "frame int, cam int, obs int, u double, v double")
    best = geometry.triangulate_frames(obs, cameras, ["frame"]).first()
    assert (best.combo, best.n_views) == (13, 3) and (best.x, best.y, best.z) == pytest.approx((0.3, 0, 6)) and best.residual < 1e-6
    assert geometry.triangulate_frames(obs, cameras, ["frame"], cap=26).first().combo == 0


def test_states_of_many_tracks_share_a_bucket(spark, monkeypatch):
    """Calls are made for buckets of tracks; a track that rests for longer than the idle time starts anew."""
    monkeypatch.setattr(s, "BUCKETS", 2)
    r = random.Random(4)
    files = [[(seq, 1000 * part + 10 * seq + k, at(3600 * part + 60 * k + r.randint(0, 50)), r.random()) for seq in range(9) for k in range(r.randint(0, 4))] for part in range(3)]
    files.append([(seq, 9000 + seq, at(3600 * 60), r.random()) for seq in range(3)])
    files += [[(8, 9300 + k, at(3600 * (110 + k)), r.random())] for k in range(2)]  # the watermark goes on, while the others rest
    files.append([(seq, 9500 + seq, at(3600 * 120), r.random()) for seq in range(3)])
    stream = s.smoothed(arriving(spark, "seq long, event_id long, ts timestamp, x double", *files), "x", idle=86400.0)
    found = {x.event_id: x.smooth for x in result(stream)}
    assert len(found) == sum(map(len, files))
    for seq in range(9):
        own = sorted((t, e, x) for rows in files[:3] for q, e, t, x in rows if q == seq)
        f = OneEuro(1.0, 0.1, 1.0)
        for t, e, x in own:
            assert found[e] == pytest.approx(float(f.step(np.float64(x), t.timestamp())))
    for q, e, _, x in files[6]:
        assert found[e] == pytest.approx(x)


def test_frames_of_one_bucket_are_triangulated_apart(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKETS", 1)
    schema = "seq long, frame long, cam int, ts timestamp, ox double, oy double, oz double, dx double, dy double, dz double"
    first = [(seq, 1, 0, at(1 + seq), float(seq), 0.0, 0.0, 0.0, 0.0, 1.0) for seq in range(6)]
    second = [(seq, 1, 1, at(9 + seq), -5.0, 0.0, 5.0 + seq, 1.0, 0.0, 0.0) for seq in range(4)] + [(7, 1, 1, at(9), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    found = result(s.live_triangulation(arriving(spark, schema, first, second), "1 hour", 86400.0))
    assert sorted((x.seq, round(x.x, 6), round(x.z, 6), x.n_views) for x in found) == [(k, float(k), 5.0 + k, 2) for k in range(4)]
