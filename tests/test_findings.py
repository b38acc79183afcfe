"""Steps that grew faster than their input, or left a part of it out."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_tables.functions import shared
from capture_tables.operators import columns, filters, geometry, joins, masks, metrics, neighbours, ranges, temporal
from capture_tables.plans import fixtures
from capture_tables.sources import readers, sinks
from capture_tables.streaming import frames


def test_nearest_times_of_one_long_sequence(spark):
    """Both sides look back: a frame up to the last row costs the square of a range's rows."""
    n = 60_000
    right = spark.range(0, n, 10).select((F.col("id") * 1.0).alias("t"), F.col("id").alias("v"))
    left = spark.range(n).select((F.col("id") + 0.25).alias("t"))
    for found in (ranges.join_nearest(left, right, [], "t", "v"), joins.join_nearest(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), ["g"], "t", "v")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan.lower()
        start = time.time()
        last = n - 10
        wrong = found.where("t <= %d and not (near_v <=> floor((t + 5) / 10) * 10)" % last).count()
        assert wrong == 0 and found.where("t > %d and near_v is not null" % last).count() == 0
        assert time.time() - start < 60


def turn(angle):
    return np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1.0]])


def test_pose_errors_move_poses_and_not_posed_points(spark, monkeypatch):
    r = np.random.default_rng(3)
    places = r.normal(size=(7, 3))
    model = [(o, 100 * o + k, *map(float, places[k % (7 - o)])) for o in (0, 1) for k in range(20)]  # most stand on others
    truth, found = ([(k, k % 2, turn(r.uniform(0, 3)), r.normal(size=3) * 0.2) for k in range(12)] for _ in range(2))
    names = "seq int, frame int, object int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double"
    gt, pr = (spark.createDataFrame([(1, k, o, *map(float, m.ravel()), *map(float, t)) for k, o, m, t in poses], names) for poses in (truth, found))
    points = spark.createDataFrame(model, "object int, pid int, mx double, my double, mz double")
    plan = metrics.add_error(pr, gt, points)._jdf.queryExecution().executedPlan().toString()
    assert not any("pid#" in line for line in plan.splitlines() if "hashpartitioning" in line)
    add = {x.frame: x["add"] for x in metrics.add_error(pr, gt, points).collect()}
    adds = {x.frame: x.adds for x in metrics.adds_error(pr, gt, points).collect()}
    monkeypatch.setattr(metrics, "WHOLE", 3)
    large = {x.frame: x.adds for x in metrics.adds_error(pr, gt, points).collect()}
    for (k, o, m, t), (_, _, m2, t2) in zip(truth, found, strict=True):
        own = np.array([p[2:] for p in model if p[0] == o])
        a, b = own @ m.T + t, own @ m2.T + t2
        assert add[k] == pytest.approx(np.linalg.norm(a - b, axis=1).mean())
        want = np.linalg.norm(a[:, None] - b[None], axis=2).min(axis=1).mean()
        assert adds[k] == pytest.approx(want) and large[k] == pytest.approx(want)


def test_groups_that_span_batches_are_worked_on_whole(spark):
    """Calls are made for batches, not for each group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        runs = [(f, v, 0, 1 + f % 3) for f in range(40) for v in range(1 + f % 20)]
        shapes = masks.mask_shape(spark.createDataFrame(runs, "frame int, v int, u0 int, u1 int"), ["frame"])
        plan = shapes._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
        assert {x.frame: x.area for x in shapes.collect()} == {f: (1 + f % 20) * (1 + f % 3) for f in range(40)}
        names = "seq int, frame int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))
        turned = spark.createDataFrame([(s, k, *map(float, turn(0.01 * k).ravel())) for s in range(9) for k in range(1 + 3 * s)], names)
        for mode in ("tangent", "geodesic"):
            found = filters.one_euro_rotation(turned, ["seq"], mode).groupBy("seq").count().collect()
            assert {x.seq: x["count"] for x in found} == {s: 1 + 3 * s for s in range(9)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_diameters_are_of_all_points(spark):
    r = np.random.default_rng(8)
    ball = r.normal(size=(1500, 3))
    clouds = {1: np.concatenate([ball, [[9, 0, 0], [-9, 1, 2]]]), 2: ball / np.linalg.norm(ball, axis=1)[:, None], 3: np.ones((2, 3)), 4: ball * [1, 1, 0]}
    points = spark.createDataFrame([(c, k, *map(float, p)) for c, ps in clouds.items() for k, p in enumerate(ps)], "cloud int, pid int, x double, y double, z double")
    found = {x.cloud: x.diameter for x in geometry.cloud_diameter(points, ["cloud"]).collect()}
    for c, ps in clouds.items():
        assert found[c] == pytest.approx(max(np.linalg.norm(ps - p, axis=1).max() for p in ps))


def test_means_at_the_threshold_are_summed_in_order(spark):
    r = np.random.default_rng(2)
    clips = []
    while len(clips) < 60:
        v = r.integers(0, 11, 16)
        if v.sum() == 64:
            clips.append((v / 10).tolist())
    rows = [(1, c, k, x) for c, v in enumerate(clips) for k, x in enumerate(v)]
    r.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(b), int(k), float(x)) for a, b, k, x in rows], "seq int, clip int, frame int, conf double")
    kept = {x.clip for x in temporal.filter_clips(df, "conf", "fp-error", 0.4).select("clip").distinct().collect()}
    want = set()
    for c, v in enumerate(clips):
        total = 0.0
        for x in v:
            total += x
        want |= set() if total / 16 < 0.4 else {c}
    assert kept == want and 0 < len(want) < 60


def test_turns_go_on_past_half_a_turn(spark):
    angles = [0.0, 0.5, 3.0, 3.3, 6.0, 7.0, 12.0]
    names = ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))
    df = spark.createDataFrame([(a, *map(float, turn(a).ravel())) for a in angles], "a double, " + names)
    out = columns.continued_turn(columns.convert_rotation(df, "matrix", "vector"), ["vx", "vy", "vz"], F.col("a")).collect()
    assert [(x.vx, x.vy, x.vz) for x in out] == [pytest.approx((0, 0, x.a), abs=1e-9) for x in out]


def test_partitions_grow_with_the_input(spark, monkeypatch):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n) for n in names}
    path = shared.shared_path(spark, "sized")
    spark.range(200_000).withColumn("x", F.rand(1)).write.parquet(f"{path}/events.parquet")
    try:
        fixtures.view(spark, path, "events")
        assert {n: spark.conf.get(n) for n in names} == before
        monkeypatch.setattr(shared, "PART_BYTES", 50_000)
        rows = fixtures.view(spark, path, "events")
        assert int(spark.conf.get(names[0])) > 30 and spark.conf.get(names[1]) == str(8 << 20)
        assert rows.count() == 200_000
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_metrics_of_many_sequences_lie_in_few_folders(spark):
    path = shared.shared_path(spark, "metrics")
    rows = lambda seqs, x: spark.createDataFrame([("base", q, k, x) for q in seqs for k in range(2)], "run string, seq long, frame int, e double")
    none = spark.range(1)
    sinks.write_metrics(rows(range(300), 1.0), none, path)
    sinks.write_metrics(rows([5, 400], 2.0), none, path)
    assert spark.read.parquet(f"{path}/frames").select("part").distinct().count() <= 64
    found = {(x.seq, x.e): x["count"] for x in spark.read.parquet(f"{path}/frames").groupBy("seq", "e").count().collect()}
    assert found == {(q, 1.0): 2 for q in range(300) if q != 5} | {(5, 2.0): 2, (400, 2.0): 2}


def test_medians_of_large_groups_are_exact(spark):
    r = np.random.default_rng(6)
    groups = {1: r.normal(size=5001), 2: r.integers(0, 3, 4000).astype(float), 3: np.array([7.0]), 4: r.exponential(size=6000) * 1e6, 5: np.array([1.0, 2.0, np.nan])}
    df = spark.createDataFrame([(g, float(x), float(-x)) for g, v in groups.items() for x in v], "g int, p double, q double")
    found = {x.g: (x.mp, x.mq) for x in masks.large_medians(df, ["g"], {"p": "mp", "q": "mq"}).collect()}
    plain = {x.g: (x.mp, x.mq) for x in df.groupBy("g").agg(F.median("p").alias("mp"), F.median("q").alias("mq")).collect()}
    assert found == plain and found[1][0] == np.median(groups[1])
    plan = masks.large_medians(df, ["g"], {"p": "mp"})._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan


def test_sequences_are_followed_in_batches(spark):
    """Chunks are followed in calls for batches, not in pandas groups for each sequence."""
    runs = [(s, f, i, v, 3 * i + f % 2, 3 * i + 4) for s in range(30) for f in range(8) for i in range(3) for v in range(2)]
    cands = spark.createDataFrame(runs, "seq int, frame int, instance int, v int, u0 int, u1 int")
    person = spark.createDataFrame([(s, f, 0, 3 * (s % 3), 3 * (s % 3) + 1) for s in range(30) for f in range(8)], "seq int, frame int, v int, u0 int, u1 int")
    chosen = masks.chained_instances(cands, person, 4, 0)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    found = {(x.seq, x.chunk): (x.instance, x.chosen_by) for x in chosen.collect()}
    # the person's column lies in two neighbouring masks: the smaller instance is taken
    first = {s: max(range(3), key=lambda i: (3 * i <= 3 * (s % 3) < 3 * i + 4, -i)) for s in range(30)}
    assert found == {(s, 0): (first[s], "person") for s in range(30)} | {(s, 1): (first[s], "previous") for s in range(30)}


def test_many_tracks_choose_at_once():
    """Choices for all frames of a bucket in whole arrays are those of the plain loop."""
    r = np.random.default_rng(1)
    for d in (0, 1, 3) * 20:
        runs, frame, person, seen, track, want, left = [], [], [], [], [], [], []
        for t in range(int(r.integers(1, 4))):
            mask: list = []
            for _ in range(int(r.integers(1, 7))):
                f = len(track)
                own = [(int(i), v, int(a), int(a + w)) for i in r.permutation(4)[: r.integers(1, 4)] for v in range(2) for a, w in [(r.integers(-3, 12), r.integers(0, 5))]]
                about = [(int(v), int(a), int(a) + 2) for v, a in zip(r.integers(-2, 4, r.integers(0, 3)), r.integers(-5, 12, 3), strict=False)]
                pick, how, mask = masks.choose_instance([dict(zip(("instance", "v", "u0", "u1"), x, strict=True)) for x in own], mask, [dict(zip(("v", "u0", "u1"), x, strict=True)) for x in about], d)
                want.append((pick, how))
                left += [(f, *x) for x in mask]
                runs, frame, person, seen, track = runs + own, frame + [f] * len(own), person + about, seen + [f] * len(about), track + [t]
        runs, frame = np.array(runs, np.int64), np.array(frame)
        pick, how, taken = masks.choose_instances(runs, frame, np.array(person, np.int64).reshape(-1, 3), np.array(seen, np.int64), np.array(track), d)
        assert list(zip(pick.tolist(), np.array(["previous", "person", "largest"])[how].tolist(), strict=True)) == want
        assert sorted((f, *x) for f, x in zip(frame[taken].tolist(), runs[taken, 1:].tolist(), strict=True)) == sorted(left)


def test_candidates_of_a_scale_share_one_target(spark, monkeypatch):
    r = np.random.default_rng(5)
    source, target = r.normal(size=(40, 3)), r.normal(size=(30, 3))
    cloud = lambda ps: spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(ps)], "cloud int, pid int, x double, y double, z double")
    met, pairs = [], neighbours.candidate_pairs
    monkeypatch.setattr(neighbours, "candidate_pairs", lambda a, b, *more: met.append(b.count()) or pairs(a, b, *more))
    ranges_ = spark.createDataFrame([(1, 0.5, 2.0)], "cloud int, lo double, hi double")
    found = {x.scale: x.score for x in geometry.pick_scale(geometry.scale_candidates(ranges_, 7, ["cloud"]), cloud(source), cloud(target), ["cloud"]).collect()}
    assert met == [30] and len(found) == 7
    for scale, score in found.items():
        moved = source.mean(axis=0) + (source - source.mean(axis=0)) * scale
        assert score == pytest.approx(np.linalg.norm(moved[:, None] - target[None], axis=2).min(axis=1).mean())


def test_files_of_a_frame_are_held_once(spark):
    """Cameras of both kinds are counted without two copies of every file; paths as the pattern had them."""
    whole = [f"/data/s/{k}/k{c}.{kind}" for k in range(2) for c in range(2) for kind in ("color.jpg", "depth.png")]
    odd = ["s/1/k0.color.jpg", "/data/s/2/k00.color.jpg", "/data/s/2/k0.color.jpg", "k0.color.jpg", "1/k0.color.jpg", "//k0.color.jpg", "/data/s/3/ak0.color.jpg", "/data/s/3/k0.color", "/data/s/3/k0.colour.jpg", "", None]
    files = spark.createDataFrame([(p,) for p in whole * 2 + odd], "path string")
    found = readers.complete_frames(files, 2, True)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x) for x in found.collect()} == {("s", "0"), ("s", "1")}
    assert {tuple(x) for x in readers.complete_frames(files, 2, False).collect()} == {("s", "0"), ("s", "1"), ("s", "2")}
    assert {tuple(x) for x in readers.complete_frames(files, 1, False).collect()} == set()


def test_a_stream_has_as_many_state_parts_as_its_events_ask_for(spark, tmp_path):
    """Two hundred parts, whatever is in them, took most of a small stream's time."""
    spark.range(40).selectExpr("id % 5 as seq", "id as event_id", "timestamp_seconds(id + 1) as ts", "double(id) as x").write.parquet(f"{tmp_path}/in")
    schema = "seq long, event_id long, ts timestamp, x double"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = frames.smoothed(frames.read_frames(spark, f"{tmp_path}/in", schema, 100), "x")
    frames.write_frames(rows, f"{tmp_path}/out", partitions=3).awaitTermination()
    assert {p.name for p in (tmp_path / "out/checkpoint/state/0").iterdir() if p.name.isdigit()} == {"0", "1", "2"}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/out/data").count() == 40


def test_frames_are_fitted_where_both_sides_met(spark):
    """One join and one batch step; joints without all their values leave the others' fit as it is."""
    r = np.random.default_rng(8)
    a, b = r.normal(size=(6, 7, 3)), r.normal(size=(6, 7, 3))
    a[1, 2, 0], b[2, :, 1] = np.nan, np.nan
    table = lambda x: spark.createDataFrame([(1, f, k, *map(float, x[f, k])) for f in range(6) for k in range(7)], "seq int, frame int, joint int, x double, y double, z double")
    found = metrics.pa_error(table(a), table(b))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
    each = {(x.frame, x.joint): x.pa_error for x in metrics.pa_error(table(a), table(b), reduction="none").collect()}
    mean = {x.frame: x.pa_error for x in found.collect()}
    total = {x.frame: x.pa_error for x in metrics.pa_error(table(a), table(b), reduction="sum").collect()}
    for f in range(6):
        known = [k for k in range(7) if np.isfinite([*a[f, k], *b[f, k]]).all()]
        assert all(each[f, k] is None for k in range(7) if k not in known)
        if not known:
            assert mean[f] is None and total[f] is None
            continue
        p, g = a[f, known], b[f, known]
        p0, g0 = p - p.mean(axis=0), g - g.mean(axis=0)
        u, d, vt = np.linalg.svd(p0.T @ g0)
        s = np.array([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
        error = np.linalg.norm((d * s).sum() / (p0 * p0).sum() * p0 @ (vt.T * s @ u.T).T - g0, axis=1)
        assert [each[f, k] for k in known] == pytest.approx(error)
        assert (mean[f], total[f]) == pytest.approx((error.mean(), error.sum()))


def test_rings_are_swept_in_one_pass(spark):
    """Runs meet in one step, without joins; against sets of pixels, with runs that overlap or hold nothing."""
    r = np.random.default_rng(9)
    sides = [[(f, int(v), int(u), int(u + w)) for f in range(40) for v, u, w in zip(r.integers(-3, 6, 5), r.integers(-4, 20, 5), r.integers(0, 7, 5), strict=True) if f % 5 != side] for side in (0, 1)]
    objects, people = (spark.createDataFrame([*side, (None, 0, 0, 3)], "frame int, v int, u0 int, u1 int") for side in sides)
    pixels = [{f: {(v, u) for g, v, u0, u1 in side if g == f for u in range(u0, u1)} for f in range(40)} for side in sides]
    for d in (0, 1, 3):
        contact = masks.ring_contact(objects, people, ["frame"], d)
        plan = contact._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        found = {x.frame: x.contact for x in contact.collect()}
        want = {}
        for f in range(40):
            own, person = pixels[0][f], pixels[1][f]
            ring = {(v + i, u + j) for v, u in own for i in range(-d, d + 1) for j in range(-d, d + 1)} - own
            if own:
                want[f] = len(ring & person) / len(ring) if ring else None
        assert found == want


def test_all_choices_of_a_frame_are_made(spark, monkeypatch):
    """Frames of 504, 3 and 1 choices, in one stretch and in several."""
    sizes = {1: (7, 8, 9), 2: (3,), 3: (1, 1, 1, 1)}
    rows = [(f, c, 10 * k, 100.0 * f + 10 * c + k) for f, n in sizes.items() for c, m in enumerate(n) for k in range(m)]
    obs = spark.createDataFrame(rows, "frame int, cam int, obs int, u double").repartition(3)
    want = {(f, i, c, 10 * k, 100.0 * f + 10 * c + k) for f, n in sizes.items() for i, p in enumerate(itertools.product(*map(range, n))) for c, k in enumerate(p)}
    assert len(want) == 3 * 504 + 3 + 4
    for stretch in (None, 50):
        if stretch:
            monkeypatch.setattr(joins, "STRETCH", stretch)
        found = list(map(tuple, joins.observation_combos(obs, ["frame"], ["u"]).collect()))
        assert len(found) == len(want) and set(found) == want


def test_the_best_of_many_choices_is_found(spark, monkeypatch):
    """343 choices, of which number 171 meets in a point; all at once and in blocks."""
    cameras = spark.createDataFrame([(c, 1024, 768, 900.0, 900.0, 512.0, 384.0, *map(float, (1, 0, 0, 0, 1, 0, 0, 0, 1)), -float(c), 0.0, 0.0) for c in range(3)],
        "cam int, width int, height int, fx double, fy double, cx double, cy double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")
    seen = lambda c, k: (1, c, k, 512.0 + 900 * (0.3 - c) / 6 + 40 * (k != 3), 384.0 + 15 * (k - 3) * (c + 1))
    obs = spark.createDataFrame([seen(c, k) for c in range(3) for k in range(7)], "frame int, cam int, obs int, u double, v double")
    for block in (None, 100):
        if block:
            monkeypatch.setattr(geometry, "CHOICES", block)
        best = geometry.triangulate_frames(obs, cameras, ["frame"]).first()
        assert (best.combo, best.n_views) == (171, 3) and (best.x, best.y, best.z) == pytest.approx((0.3, 0, 6)) and best.residual < 1e-6
    combos = joins.observation_combos(obs, ["frame"], ["u", "v"])
    assert geometry.triangulate_best(combos, cameras, ["frame"]).first().combo == 171
