"""Operators without SQL against plain Python on small or given tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_tables.operators import columns, filters, geometry, masks, metrics, neighbours, temporal
from capture_tables.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
R = [f"r{i}{j}" for i in range(3) for j in range(3)]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def turn(axis, angle):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def euro(values, times, least=1.0, beta=0.1, speed_cutoff=1.0):
    """The filter as a plain loop over numbers."""
    alpha = lambda cut, dt: 1 / (1 + 1 / (2 * math.pi * cut * dt))
    out, speed = [values[0]], 0.0
    for k in range(1, len(values)):
        dt = max(times[k] - times[k - 1], 1e-9)
        a = alpha(speed_cutoff, dt)
        speed = a * (values[k] - out[-1]) / dt + (1 - a) * speed
        b = alpha(least + beta * abs(speed), dt)
        out.append(b * values[k] + (1 - b) * out[-1])
    return out


def test_one_euro_equals_a_plain_loop(spark):
    r = np.random.default_rng(1)
    data = {seq: sorted((int(f), float(x)) for f, x in zip(r.choice(60, 30, False), r.normal(size=30))) for seq in (1, 2)}
    df = spark.createDataFrame([(s, f, x) for s, rows in data.items() for f, x in rows], "seq int, frame int, x double")
    found = {(a.seq, a.frame): a.x for a in filters.one_euro(df, ["x"], ["seq"], freq=30.0).collect()}
    for seq, rows in data.items():
        for (f, _), y in zip(rows, euro([x for _, x in rows], [f / 30 for f, _ in rows]), strict=True):
            assert found[seq, f] == pytest.approx(y)


@needs_tables
def test_streamed_smoothing_equals_a_plain_loop(spark):
    found = {(x.seq, x.event_id): x.smooth for x in registry.QUERIES["s5_smoothed"](spark, SF).collect()}
    rows = fixtures.view(spark, SF, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 as t", "value / 100 as x").collect()
    tracks = {}
    for x in rows:
        tracks.setdefault(x.user_id, []).append((float(x.t), x.event_id, float(x.x)))
    checked = 0
    for seq, track in tracks.items():
        track.sort()
        # a track that rests for longer than a day may have started anew: up to there
        rest = next((k for k in range(1, len(track)) if track[k][0] - track[k - 1][0] >= 86_400), len(track))
        for (_, event, _), y in zip(track[:rest], euro([x for *_, x in track[:rest]], [t for t, *_ in track[:rest]]), strict=True):
            assert found[seq, event] == pytest.approx(y, abs=1e-6)
            checked += 1
    assert checked > 50 and len(found) == len(rows)


@needs_tables
def test_live_triangulation_meets_its_points(spark):
    found = registry.QUERIES["s9_live_triangulation"](spark, SF).collect()
    good = [x for x in found if x.x is not None]
    assert len(good) > 20 and all((x.x, x.y, x.z) == pytest.approx((0.5, 0.1, 7.0), abs=1e-3) for x in good)


def test_clips_turn_round_whole(spark):
    rows = [(1, clip, 10 * clip + p, p) for clip in range(60) for p in range(4)]
    df = spark.createDataFrame(rows, "seq int, clip int, frame int, pos int")
    for chance, share in ((0.0, (0, 0)), (1.0, (60, 60)), (0.5, (12, 48))):
        found = temporal.reverse_clips(df, chance, seed=3).collect()
        turned = {x.clip for x in found if x.reversed}
        assert share[0] <= len(turned) <= share[1]
        for x in found:
            p = x.frame - 10 * x.clip
            assert x.pos == (3 - p if x.clip in turned else p)
        assert {x.clip for x in temporal.reverse_clips(df.repartition(7), chance, seed=3).collect() if x.reversed} == turned


def test_perturbed_poses_stay_near_and_repeat(spark):
    rows = [(1, k, *map(float, turn([1, 2, 3], 0.1 * k).ravel()), 1.0, 2.0, 3.0) for k in range(50)]
    df = spark.createDataFrame(rows, "seq int, frame int, " + ", ".join(f"{c} double" for c in R) + ", tx double, ty double, tz double")
    one, two = ({x.frame: x for x in columns.perturb_poses(d, 0.3, 0.05, 17, "seq", "frame").collect()} for d in (df, df.repartition(5)))
    angles, lengths = [], []
    for k in range(50):
        m = np.array([one[k][c] for c in R]).reshape(3, 3)
        assert m @ m.T == pytest.approx(np.eye(3)) and one[k] == two[k]
        angles.append(np.arccos(np.clip((np.trace(m @ turn([1, 2, 3], 0.1 * k).T) - 1) / 2, -1, 1)))
        lengths.append(np.linalg.norm([one[k].tx - 1, one[k].ty - 2, one[k].tz - 3]))
    assert max(angles) <= 0.3 and max(lengths) <= 0.05 + 1e-9 and np.std(angles) > 0.03 and np.std(lengths) > 0.005


def test_augmented_pixels(spark):
    df = spark.createDataFrame([(1, v, u, 2.0) for v in range(20) for u in range(50)], "frame int, v int, u int, z double")
    go = lambda spec: {(x.v, x.u): x.z for x in columns.augment_pixels(df, spec, 5, "frame", "v", "u").collect()}
    assert len(go({"kind": "drop", "by": ["frame"], "share": 0.1234})) == 1000 - 123
    noise = np.array(list(go({"kind": "noise", "std": 0.01, "most": 0.02}).values())) - 2
    assert abs(noise.mean()) < 0.002 and 0.007 < noise.std() < 0.011 and abs(noise).max() <= 0.02 + 1e-12
    gone = {(v, u) for v in range(20) for u in range(50)} - set(go({"kind": "ellipse", "u": 20.0, "v": 5.0, "a": 4.0, "b": 2.0}))
    assert gone == {(v, u) for v in range(20) for u in range(50) if ((u - 20) / 4) ** 2 + ((v - 5) / 2) ** 2 <= 1}
    salt = list(go({"kind": "salt", "share": 0.2, "low": 0.0, "high": 9.0}).values())
    assert 60 < salt.count(0.0) < 140 and 60 < salt.count(9.0) < 140 and salt.count(2.0) == 1000 - salt.count(0.0) - salt.count(9.0)
    assert set(go({"kind": "scale", "gain": 2.0, "offset": -1.0}).values()) == {3.0}


def _joints(spark, frames):
    return spark.createDataFrame([(1, f, j, *map(float, p)) for f, cloud in frames.items() for j, p in enumerate(cloud)], "seq int, frame int, joint int, x double, y double, z double")


def test_similarity_alignment_recovers_the_truth(spark):
    r = np.random.default_rng(7)
    truth = {f: r.normal(size=(6, 3)) for f in range(3)}
    moved = {f: 1.7 * c @ turn([1, 0, 2], 0.8).T + [1, -2, 3] for f, c in truth.items()}
    gt, pr = _joints(spark, truth), _joints(spark, moved)
    assert all(x.pa_error < 1e-6 for x in metrics.pa_error(pr, gt).collect())
    for x in metrics.align_first_frame(pr, gt).collect():
        assert [x.x, x.y, x.z] == pytest.approx(truth[x.frame][x.joint].tolist(), abs=1e-6)
    bent = dict(moved)
    bent[1] = moved[1] + r.normal(0, 0.2, (6, 3))
    a = bent[1] - bent[1].mean(axis=0)
    b = truth[1] - truth[1].mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    scale = np.trace(np.diag(s) @ d) / (a**2).sum()
    error = np.linalg.norm(scale * a @ (u @ d @ vt) - b, axis=1).mean()
    found = {x.frame: x.pa_error for x in metrics.pa_error(_joints(spark, bent), gt).collect()}
    assert found[1] == pytest.approx(error, abs=1e-5)


def test_a_constant_residual_rotation_is_told_from_a_changing_one(spark):
    r = np.random.default_rng(9)
    base = [turn(r.normal(size=3), r.uniform(0, 3)) for _ in range(20)]
    rows = lambda turns: [(s, k, *map(float, m.ravel())) for s, ms in turns.items() for k, m in enumerate(ms)]
    schema = "seq int, frame int, " + ", ".join(f"{c} double" for c in R)
    fixed = turn([0, 1, 0], 0.5)
    a = spark.createDataFrame(rows({1: base, 2: base}), schema)
    b = spark.createDataFrame(rows({1: [m @ fixed for m in base], 2: [m @ turn([0, 1, 0], 0.1 * k) for k, m in enumerate(base)]}), schema)
    found = {x.seq: x for x in metrics.frame_convention(a, b).collect()}
    assert found[1].constant and not found[2].constant
    assert found[1].min_angle == pytest.approx(math.degrees(0.5)) == pytest.approx(found[1].max_angle)
    assert [found[1].mvx, found[1].mvy, found[1].mvz] == pytest.approx([0, 0.5, 0], abs=1e-6)


def test_mask_shape_of_the_largest_part(spark):
    runs = [(1, v, 0, 4) for v in range(4)] + [(1, 9, 0, 3), (1, 4, 4, 9)]  # a square, and two apart from it
    runs += [(2, v, 0, 1 + v) for v in range(10)]  # a staircase
    found = {x.frame: x for x in masks.mask_shape(spark.createDataFrame(runs, "frame int, v int, u0 int, u1 int"), ["frame"]).collect()}
    assert (found[1].area, found[1].solidity) == (16, pytest.approx(1)) and found[1].fill == pytest.approx(16 / (math.pi * 8))
    # the hull is (0, 0), (1, 0), (10, 9), (10, 10), (0, 10)
    assert found[2].area == 55 and found[2].solidity == pytest.approx(55 / 59.5)


def test_surface_samples_spread_by_area(spark):
    faces = [(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 1, 5.0, 0.0, 0.0, 8.0, 0.0, 0.0, 5.0, 1.0, 0.0), (1, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    names = "cloud int, face int, " + ", ".join(f"{v}{k} double" for v in "abc" for k in "xyz")
    found = geometry.sample_surface(spark.createDataFrame(faces, names), 400, 3, ["cloud"], "face").collect()
    first = [x for x in found if x.face == 0]
    assert len(found) == 400 and abs(len(first) - 100) <= 1 and all(x.face in (0, 1) for x in found)
    assert all(x.x >= 0 and x.y >= 0 and x.x + x.y <= 1 and x.z == 0 for x in first)
    assert np.mean([(x.x, x.y) for x in first], axis=0) == pytest.approx([1 / 3, 1 / 3], abs=0.08)


def test_flipped_axes_are_found(spark):
    r = np.random.default_rng(4)
    long = r.normal(size=(200, 3)) * [5, 1, 1]
    rows = [(c, k, *map(float, p)) for c in (1, 2) for k, p in enumerate(long)]
    other = [(1, k, *map(float, p)) for k, p in enumerate(long @ turn([0, 0, 1], 0.3).T)] + [(2, k, *map(float, p)) for k, p in enumerate(long[:, [1, 0, 2]])]
    a, b = (spark.createDataFrame(x, "cloud int, pid int, x double, y double, z double") for x in (rows, other))
    found = {x.cloud: x for x in geometry.is_flipped(a, b, ["cloud"]).collect()}
    assert not found[1].flipped and found[1].dot == pytest.approx(math.cos(0.3), abs=0.02) and found[2].flipped


def test_pose_clusters_equal_a_greedy_loop(spark):
    r = np.random.default_rng(6)
    rows = [(g, k, "box", float(r.uniform()), turn([0, 0, 1], r.uniform(0, 3)), r.uniform(0, 0.6, 3)) for g in (1, 2) for k in range(25)]
    sym = [turn([0, 0, 1], 0.0), turn([0, 0, 1], math.pi)]
    names = ", ".join(f"{c} double" for c in R)
    poses = spark.createDataFrame([(g, k, o, s, *map(float, m.ravel()), *map(float, t)) for g, k, o, s, m, t in rows], f"grp int, k int, object string, score double, {names}, tx double, ty double, tz double")
    symmetries = spark.createDataFrame([("box", n, *map(float, m.ravel())) for n, m in enumerate(sym)], "object string, sym_id int, " + names.replace("r", "s"))
    found = {(x.grp, x.k): x.cluster for x in geometry.cluster_poses(poses, symmetries, ["grp"], "score", "k", 0.4, 0.5).collect()}
    for grp in (1, 2):
        kept = []
        for _, k, _, _, m, t in sorted((x for x in rows if x[0] == grp), key=lambda x: -x[3]):
            near = [n for n, (rm, rt) in enumerate(kept) if min(np.arccos(np.clip((np.trace(rm.T @ m @ s) - 1) / 2, -1, 1)) for s in sym) <= 0.4 and np.linalg.norm(rt - t) <= 0.5]
            assert found[grp, k] == (near[0] if near else len(kept))
            if not near:
                kept.append((m, t))


def test_nearest_rows_equal_all_pairs(spark):
    """Far points, single points, equal points and groups without points."""
    r = np.random.default_rng(8)
    b = [(1, k, *map(float, p)) for k, p in enumerate(r.normal(size=(60, 3)))] + [(2, 0, 1.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0), (4, 0, 0.0, 0.0, 0.0)]
    a = [(1, k, *map(float, p)) for k, p in enumerate(r.normal(size=(40, 3)) * 3)] + [(1, 99, 1e6, -1e6, 0.0), (2, 0, 1.0, 1.0, 1.0), (2, 1, 9.0, 9.0, 9.0), (3, 0, 0.0, 0.0, 0.0)]
    schema = "g int, pid int, x double, y double, z double"
    from capture_tables.operators import neighbours

    best = neighbours.nearest_row(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumn("own", F.col("pid")), ["g"], "pid", ["own"]).collect()
    found = {(x.g, x.pid): (x.best.d2, x.best._keep.own) for x in best}
    assert len(found) == 43
    for g, k, *p in a:
        if g != 3:
            d2, own = min((sum((i - j) ** 2 for i, j in zip(p, q, strict=True)), n) for h, n, *q in b if h == g)
            assert found[g, k] == (pytest.approx(d2), own)


def _all_pairs(a, b, k):
    """For each row of a the k smallest (d2, row of b), in blocks."""
    out = []
    for at in range(0, len(a), 256):
        d2 = ((a[at : at + 256, None] - b[None]) ** 2).sum(axis=2)
        near = np.argsort(d2, axis=1, kind="stable")[:, :k]
        out += [[(float(row[j]), int(j)) for j in picks] for row, picks in zip(d2, near, strict=True)]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_of_skewed_clouds_equal_all_pairs(spark, monkeypatch, k):
    """A volume, a surface, two distant clusters, a heavy tail and equal points, by blocks."""
    monkeypatch.setattr(neighbours, "WHOLE", 10)
    r = np.random.default_rng(3)
    ball = r.normal(size=(900, 3))
    clouds = {
        1: (r.random((700, 3)), np.vstack([r.random((1200, 3)), [[1e7, -1e7, 1e7]]])),
        2: (ball / np.linalg.norm(ball, axis=1, keepdims=True) * 1.1, ball / np.linalg.norm(ball, axis=1, keepdims=True)),
        3: (np.vstack([r.normal(size=(300, 3)) * 1e-3, r.normal(size=(300, 3)) * 1e-3 + 500]), np.vstack([r.normal(size=(400, 3)) * 1e-3 + 1, r.normal(size=(400, 3)) * 1e-3 + 500])),
        4: (r.standard_cauchy((300, 3)), r.standard_cauchy((800, 3))),
        5: (np.zeros((50, 3)), np.zeros((100, 3))),
        6: (r.random((40, 3)) + 1e5, r.random((2, 3))),
    }
    rows = [[(g, j, *map(float, p)) for g, sides in clouds.items() for j, p in enumerate(sides[side])] for side in range(2)]
    a, b = (spark.createDataFrame(x, "g int, pid int, x double, y double, z double") for x in rows)
    found = {}
    for x in neighbours.knn_join(a, b, ["g"], "pid", "other", k, squared=True).collect():
        found.setdefault((x.g, x.pid), {})[x["rank"]] = x.distance
    for g, (one, two) in clouds.items():
        for j, best in enumerate(_all_pairs(one, two, k)):
            assert [found[g, j][n + 1] for n in range(len(best))] == pytest.approx([d2 for d2, _ in best], rel=1e-9, abs=1e-12)


def test_few_pairs_are_compared_in_a_large_cloud_with_an_outlier(spark):
    """60,000 points of a volume, one of them far away: the pairs for each point are bounded."""
    cloud = spark.range(60_000).selectExpr("1 as g", "id as pid", "rand(1) as x", "rand(2) as y", "rand(3) as z")
    b = cloud.unionByName(spark.createDataFrame([(1, -1, 1e9, 0.0, 0.0)], "g int, pid long, x double, y double, z double"))
    a = spark.range(20_000).selectExpr("1 as g", "id as pid", "rand(4) as x", "rand(5) as y", "rand(6) as z")
    pairs = neighbours.candidate_pairs(a, b, ["g"], "pid", ["pid"])
    least = pairs.groupBy("pid").agg(F.min("d2").alias("d2"), F.count("*").alias("n"))
    assert least.agg(F.avg("n")).first()[0] < 1500
    points = np.array([(x.x, x.y, x.z) for x in b.orderBy("pid").collect()])
    some = a.where("pid % 200 = 7").join(least, "pid").collect()
    wanted = _all_pairs(np.array([(x.x, x.y, x.z) for x in some]), points, 1)
    assert len(some) == 100 and [x.d2 for x in some] == pytest.approx([w[0][0] for w in wanted])


@pytest.mark.parametrize("radius", [1, 2])
def test_depth_filters_on_tiles_equal_a_plain_loop(spark, radius):
    """An image over several tiles, with holes, from negative places on."""
    r = np.random.default_rng(4)
    z = {(v, u): float(np.round(r.normal(2, 0.3), 3)) for v in range(-3, 70) for u in range(60, 101) if r.random() < 0.7}
    df = spark.createDataFrame([(1, v, u, x, "kept") for (v, u), x in z.items()], "img int, v int, u int, z double, more string")
    window = lambda v, u: {(dv, du): z[v + dv, u + du] for dv in range(-radius, radius + 1) for du in range(-radius, radius + 1) if (v + dv, u + du) in z}
    smooth = {(x.v, x.u): x.z for x in masks.bilateral_depth(df, ["img"], radius, near=0.20037).where("more = 'kept'").collect()}
    inside = {k for k in z if k[0] >= 0}
    eroded = {(x.v, x.u): x.z for x in masks.erode_depth(df.where("v >= 0"), ["img"], 70, 101, radius, 0.3, 0.6).collect()}
    assert smooth.keys() == z.keys()
    for (v, u), own in z.items():
        near = window(v, u)
        mean = sum(near.values()) / len(near)
        weights = {k: math.exp(-(k[0] ** 2 + k[1] ** 2) / 8 - (x - own) ** 2 / 0.02) for k, x in near.items() if abs(x - mean) < 0.20037}
        total = sum(weights.values())
        assert smooth[v, u] == pytest.approx(sum(w * near[k] for k, w in weights.items()) / total if total > 0 else own)
        if v >= 0:
            n = (min(v + radius, 69) - max(v - radius, 0) + 1) * (min(u + radius, 100) - max(u - radius, 0) + 1)
            good = sum(abs(x - own) <= 0.3 for k, x in near.items() if (v + k[0], u + k[1]) in inside)
            assert ((v, u) in eroded) == ((n - good) / n <= 0.6)
