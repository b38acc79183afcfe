"""Hand-made cases: mask runs, geometry, filters and guards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_tables.operators import columns, filters, geometry, masks, metrics, ranking, temporal
from capture_tables.operators import joins, neighbours


def flags(spark, bits):
    return spark.createDataFrame([(1, k, bool(b)) for k, b in enumerate(bits)], "seq long, frame int, tracked boolean")


@pytest.mark.parametrize(
    ("bits", "gap", "wanted"),
    [
        ([0, 1, 1, 0, 1], 0, [(1, 2), (4, 4)]),
        ([1, 1, 1, 1], 0, [(0, 3)]),
        ([0, 0, 0, 0], 0, []),
        ([1, 1, 0, 1, 1], 0, [(0, 1), (3, 4)]),
        ([1, 1, 0, 1, 1], 1, [(0, 4)]),
        ([1, 1, 0, 0, 0, 1], 2, [(0, 1), (5, 5)]),
        ([1, 1, 0, 0, 0, 1], 3, [(0, 5)]),
        ([1, 1, 0, 0], 5, [(0, 1)]),
    ],
)
def test_runs_bridge_gaps_and_end_on_tracked_frames(spark, bits, gap, wanted):
    runs = temporal.tracked_runs(flags(spark, bits), F.col("tracked"), gap)
    assert sorted((r.lo, r.hi) for r in runs.collect()) == wanted


def test_runs_are_ranked_by_length(spark):
    runs = temporal.rank_runs(temporal.tracked_runs(flags(spark, [1, 1, 0, 1, 1, 1, 1, 0, 1]), F.col("tracked"), 0))
    assert [(r.lo, r.hi) for r in runs.orderBy("rank").collect()] == [(3, 6), (0, 1), (8, 8)]


def test_a_take_without_runs_stays_whole_and_a_missing_rank_is_an_error(spark):
    none = flags(spark, [0, 0, 0])
    assert temporal.trim_to_run(none, F.col("tracked")).count() == 3
    with pytest.raises(Exception, match="fewer than 2 runs"):
        temporal.trim_to_run(flags(spark, [1, 1]), F.col("tracked"), rank=2).collect()


def test_timeline_keeps_a_single_dropout(spark):
    bar = temporal.timeline(flags(spark, [k != 50 for k in range(100)]), F.col("tracked"), 10).collect()
    assert len(bar) == 10 and sum(not r.green for r in bar) == 1


def test_perpendicular_rays_meet_and_parallel_rays_do_not(spark):
    rows = [("a", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("a", 2.0, -3.0, 0.0, 0.0, 1.0, 0.0), ("b", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("b", 0.0, 1.0, 0.0, 1.0, 0.0, 0.0)]
    rays = spark.createDataFrame(rows, "k string, ox double, oy double, oz double, dx double, dy double, dz double")
    found = {r.k: r for r in geometry.triangulate(rays, ["k"]).collect()}
    assert (found["a"].x, found["a"].y, found["a"].z) == pytest.approx((2, 0, 0)) and found["a"].gap == pytest.approx(0)
    assert found["b"].x is None


def _pose(spark, angle, t=0.0):
    c, s = math.cos(angle), math.sin(angle)
    names = ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))
    return spark.createDataFrame([(1, 0, 7, c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0, t, 0.0, 0.0)], f"seq long, frame int, object int, {names}, tx double, ty double, tz double")


def test_rotation_error_is_the_smallest_over_symmetries(spark):
    names = ", ".join(f"s{i}{j} double" for i in range(3) for j in range(3))
    turns = [(7, k, *m) for k, m in enumerate([(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)])]
    sym = spark.createDataFrame(turns, f"object int, sym_id int, {names}")
    one = metrics.pose_error(_pose(spark, math.pi / 2, 0.3), _pose(spark, 0.0), sym.where("sym_id = 0")).first()
    both = metrics.pose_error(_pose(spark, math.pi / 2, 0.3), _pose(spark, 0.0), sym).first()
    assert one.rot_error == pytest.approx(math.pi / 2) and both.rot_error == pytest.approx(0, abs=1e-6)
    assert one.trans_error == pytest.approx(0.3)


def test_scale_and_shift_are_recovered(spark):
    rows = [(1, v, u, 1.0 + 0.1 * v + 0.01 * u * u) for v in range(4) for u in range(5)]
    pred = spark.createDataFrame(rows, "seq int, v int, u int, z double")
    found = masks.fit_scale_shift(pred, pred.withColumn("z", F.col("z") * 2 + 0.5), ["seq"]).first()
    assert (found.scale, found.shift) == pytest.approx((2, 0.5))


def test_chamfer_is_symmetric_and_works_on_one_point(spark):
    a = spark.createDataFrame([("c", 1, 0.0, 0.0, 0.0)], "cloud string, pid int, x double, y double, z double")
    b = spark.createDataFrame([("c", 1, 3.0, 4.0, 0.0)], "cloud string, pid int, x double, y double, z double")
    assert metrics.chamfer(a, b, ["cloud"]).first().chamfer == pytest.approx(10)
    assert metrics.chamfer(b, a, ["cloud"]).first().chamfer == pytest.approx(10)


def test_bucketed_search_equals_the_plain_one(spark):
    p = spark.range(200).selectExpr("'c' as cloud", "id as pid", "(id * 37 % 101) / 10d as x", "(id * 53 % 97) / 10d as y", "(id * 71 % 89) / 10d as z")
    a, b = p.where("pid % 2 = 0"), p.where("pid % 2 = 1")
    near = {r.pid: r.distance for r in neighbours.nearest(a, b, ["cloud"]).collect()}
    found = {r.pid: r.distance for r in neighbours.knn_join(a, b, ["cloud"], "pid", "other", 1).collect()}
    assert found == pytest.approx(near)


def test_one_euro_keeps_a_constant_and_follows_a_step(spark):
    rows = spark.createDataFrame([(1, k, 5.0, 0.0 if k < 10 else 1.0) for k in range(40)], "seq int, frame int, a double, b double")
    out = filters.one_euro(rows, ["a", "b"], ["seq"], freq=30.0).orderBy("frame").collect()
    assert all(r.a == pytest.approx(5) for r in out)
    rising = [r.b for r in out[10:]]
    assert rising == sorted(rising) and 0 < rising[0] < 1 and rising[-1] > 0.5


def test_rotation_filters_keep_a_constant_rotation(spark):
    pose = _pose(spark, 0.7)
    many = pose.select("seq", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"), *[f"r{i}{j}" for i in range(3) for j in range(3)])
    for mode in ("tangent", "geodesic"):
        out = filters.one_euro_rotation(many, ["seq"], mode).collect()
        assert all(r.r01 == pytest.approx(-math.sin(0.7)) for r in out)


def _turn(v):
    angle = np.linalg.norm(v)
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_rotation_filters_equal_a_plain_loop(spark):
    """About one axis the filters are those of the angles between the last result and the next."""
    r = np.random.default_rng(2)
    axis = np.array([0.6, 0.0, 0.8])
    angles = np.cumsum(r.normal(0, 0.3, 30))
    rows = [(1, k, *map(float, _turn(a * axis).ravel())) for k, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "seq int, frame int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    dt, alpha = 1 / 30, lambda cut: 1 / (1 + 30 / (2 * np.pi * cut))
    last, seen, speed, tangent = angles[0], None, np.zeros(3), [angles[0]]
    for a in angles[1:]:
        v = (a - last) * axis
        if seen is None:
            seen = v
        else:
            speed = alpha(1.0) * (v - seen) / dt + (1 - alpha(1.0)) * speed
            share = np.array([alpha(0.5 + 2.0 * abs(x)) for x in speed])
            seen = share * v + (1 - share) * seen
        last = last + seen @ axis
        tangent.append(last)
    last, geodesic = angles[0], [angles[0]]
    for a in angles[1:]:
        last += (a - last) * alpha(0.5 + 2.0 * abs(a - last) / dt)
        geodesic.append(last)
    for mode, wanted in (("geodesic", geodesic), ("tangent", tangent)):
        out = filters.one_euro_rotation(df, ["seq"], mode).orderBy("frame").collect()
        if mode == "tangent":  # the three axes are filtered apart: the result leaves the plane
            assert out[1].r01 == pytest.approx(_turn(tangent[1] * axis)[0, 1])
            turn, seen, speed = _turn(angles[0] * axis), None, np.zeros(3)
            for k, a in enumerate(angles[1:], 1):
                m = turn.T @ _turn(a * axis)
                angle = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
                v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) * (angle / (2 * np.sin(angle)))
                if seen is None:
                    seen = v
                else:
                    speed = alpha(1.0) * (v - seen) / dt + (1 - alpha(1.0)) * speed
                    share = np.array([alpha(0.5 + 2.0 * abs(x)) for x in speed])
                    seen = share * v + (1 - share) * seen
                turn = turn @ _turn(seen)
                assert [out[k][f"r{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(turn.ravel().tolist(), abs=1e-6)
        else:
            for row, angle in zip(out, wanted, strict=True):
                assert row.r01 == pytest.approx(_turn(angle * axis)[0, 1], abs=1e-6)


def test_lens_terms_are_told_apart(spark):
    """One tangential or prism term at a time, by its formula at a point off both axes."""
    names = columns.F624
    zero = dict.fromkeys(names, 0.0) | {"f": 1.0}
    scale = np.arctan(0.5) / 0.5
    x, y = 0.3 * scale, 0.4 * scale
    q = x * x + y * y
    moved = {"p0": (2 * x * y, q + 2 * y * y), "p1": (q + 2 * x * x, 2 * x * y), "s0": (q, 0), "s1": (q * q, 0), "s2": (0, q), "s3": (0, q * q)}
    for name, (dx, dy) in moved.items():
        p = zero | {name: 0.01}
        df = spark.createDataFrame([(0.3, 0.4, 1.0, *[p[n] for n in names])], ["x", "y", "z", *names])
        row = columns.project_f624(df).first()
        assert (row.u, row.v) == pytest.approx((x + 0.01 * dx, y + 0.01 * dy))
    p = zero | {"p0": 0.1, "s0": 0.2}  # the prism's radius follows the tangential step
    u, v = x + 0.1 * 2 * x * y, y + 0.1 * (q + 2 * y * y)
    df = spark.createDataFrame([(0.3, 0.4, 1.0, *[p[n] for n in names])], ["x", "y", "z", *names])
    assert (columns.project_f624(df).first().u, columns.project_f624(df).first().v) == pytest.approx((u + 0.2 * (u * u + v * v), v))


def test_depth_registration_finds_shift_and_scale(spark):
    r = np.random.default_rng(5)
    cloud = r.uniform(-0.3, 0.3, (400, 3)) * [1, 1, 0.2] + [0, 0, 2.0]
    rows = [(1, *map(float, x)) for x in cloud]
    other = [(1, *map(float, x * [1.1, 1.1, 1.1])) for x in cloud] + [(2, 0.0, 0.0, 3.0)]
    a, b = spark.createDataFrame(rows, "cloud int, x double, y double, z double"), spark.createDataFrame(other, "cloud int, x double, y double, z double")
    out = {x.cloud: x for x in geometry.register_z(a, b, ["cloud"]).collect()}
    assert out[1].scale == pytest.approx(1.1, abs=0.01) and abs(out[1].z_shift) < 0.02 and out[1].inliers > 100
    assert out[2].z_shift is None and out[2].inliers == 0
    near = a.withColumn("z", F.col("z") / 4)
    assert geometry.register_z(near, near, ["cloud"]).first().z_shift is None


_HYPOTHESIS = "seq int, frame int, rank int, visibility double, iou double, t double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))


def hypothesis(frame, rank, degrees, visibility=0.9, iou=0.6):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (1, frame, rank, visibility, iou, frame / 30, c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0)


def track(spark, rows, **given):
    found = filters.select_track(spark.createDataFrame(rows, _HYPOTHESIS), ["seq"], **given)
    return {r.frame: (r["rank"], r.gated) for r in found.collect()}


def test_a_visible_frame_outside_the_gate_is_no_reference(spark):
    """Frame 2 is turned by 170 degrees: the track passes over it and comes back from behind."""
    rows = [hypothesis(k, 0, 170 if k == 2 else 0) for k in range(8)]
    found = track(spark, rows, ahead=3)
    assert found[2] == (0, False) and all(found[k] == (0, True) for k in (1, 3, 4, 5, 6, 7))
    # with another hypothesis for it, the one within the gate is taken
    assert track(spark, [*rows, hypothesis(2, 1, 5)], ahead=3)[2] == (1, True)
    # near the end nothing can be jumped to
    assert track(spark, rows[:5], ahead=3) == {0: (0, False), 1: (0, True), 2: (0, False), 3: (0, False), 4: (0, True)}


def test_the_gate_sleeps_after_a_long_occlusion(spark):
    rows = [hypothesis(0, 0, 0), *[hypothesis(k, 0, 3, 0.1) for k in range(40, 44)], hypothesis(44, 0, 90, 0.1), hypothesis(44, 1, 4, 0.1)]
    assert track(spark, rows)[44] == (0, False)
    assert track(spark, rows, occluded=100)[44] == (1, True) == track(spark, rows, occluded=100, time="t")[44]
    # asleep, the track jumps: the frames passed over follow the one it lands on
    rows = [hypothesis(0, 0, 0), *[h for k in range(40, 46) for h in (hypothesis(k, 0, 0, 0.1), hypothesis(k, 1, 92, 0.1))], *[hypothesis(k, 0, 90) for k in range(46, 50)]]
    assert [track(spark, rows, ahead=4)[k] for k in (40, 41, 45, 46)] == [(0, True), (1, True), (1, True), (0, True)]


def test_track_candidates_are_the_best_by_overlap(spark):
    rows = [hypothesis(0, 0, 0), hypothesis(1, 0, 0, iou=0.1), hypothesis(1, 1, 0, iou=0.9)]
    assert track(spark, rows, iou="iou", iou_kept=0)[1] == (1, True) and track(spark, rows)[1] == (0, True)
    # strides go on until a last frame is reliable
    rows = [hypothesis(0, 0, 0), *[hypothesis(k, 0, 170, 0.9, 0.2 if k < 7 else 0.8) for k in range(1, 12)]]
    assert {k for k, (_, gated) in track(spark, rows, ahead=3, iou="iou").items() if gated} == set(range(1, 12))
    with pytest.raises(ValueError, match="two frames"):
        track(spark, rows, ahead=1)


def plain_track(frames, visible=0.3, base=13.0, omega=0.5, ahead=4, occluded=3, kept=2, sure_iou=0.5, sure_vis=0.7):
    """Frames are lists of (degrees, visibility, iou) about one axis; the choices as a plain loop."""
    apart = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
    choice, n, k = {}, len(frames), 0
    pose = None
    vis_last = last_vis = 0

    def good(f):
        least = sorted((h[2] for h in frames[f]), reverse=True)[min(kept, len(frames[f]) - 1)]
        return [j for j, h in enumerate(frames[f]) if h[2] >= least]

    while k < n:
        jump, ids, gate = False, good(k), False
        if pose is not None and (vis_last > visible or k - last_vis < occluded):
            ids = [j for j in ids if apart(frames[k][j][0], pose) < base + (k - last_vis) * omega]
            gate = bool(ids)
            if not ids:
                ids, jump = list(range(len(frames[k]))), True
        else:
            jump = k > 0
        if k + ahead >= n:
            jump = False
        if not jump:
            choice[k] = (ids[0], gate)
            pose, vis_last = frames[k][ids[0]][:2]
            if vis_last > visible:
                last_vis = k
            k += 1
            continue
        start = k
        while True:
            i = min(start + ahead, n) - 1
            ok = [j for j, h in enumerate(frames[i]) if h[2] >= sure_iou]
            if (not ok or frames[i][0][1] < sure_vis) and start + ahead < n:
                start += ahead
                continue
            ok = ok or list(range(len(frames[i])))
            landed = 0 if start + ahead >= n else ok[0]
            break
        before, seen, active = frames[i][landed][0], i, True
        for f in range(i - 1, k - 1, -1):
            ids = good(f)
            if active:
                close = [j for j in ids if apart(frames[f][j][0], before) < base + (seen - f) * omega]
                active, ids = bool(close), close or ids
            choice[f] = (ids[0], active)
            before = frames[f][ids[0]][0]
            if frames[f][ids[0]][1] > visible:
                seen = f
        last_vis, vis_last, pose, k = i, frames[i][ok[0]][1], frames[i][landed][0], i
    return choice


def test_track_selection_equals_a_plain_loop(spark):
    r = random.Random(8)
    for _ in range(12):
        angle, frames = 0.0, []
        for _ in range(r.randint(1, 60)):
            angle += r.uniform(-8, 8)
            frames.append([(angle + r.choice([0, 0, 5, 60, 170]), r.choice([0.1, 0.2, 0.5, 0.9]), round(r.random(), 3)) for _ in range(r.randint(1, 5))])
        rows = [hypothesis(k, j, *h) for k, f in enumerate(frames) for j, h in enumerate(f)]
        assert track(spark, rows, ahead=4, occluded=3, iou="iou", iou_kept=2) == plain_track(frames)


def test_kth_best_threshold_is_clamped(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(5)], "seq int, s double")
    assert ranking.keep_kth(df, "s", 2).count() == 2 and ranking.keep_kth(df, "s", 31).count() == 5


def test_a_short_prediction_is_padded_and_a_shorter_one_fails(spark):
    truth = spark.createDataFrame([(1, k, float(k)) for k in range(10)], "seq int, frame int, x double")
    out = joins.align_lengths(truth, truth.where("frame < 7"), ["seq"], "frame", "x").orderBy("frame").collect()
    assert [r.pr_x for r in out[-4:]] == [6.0] * 4
    with pytest.raises(Exception, match="too short"):
        joins.align_lengths(truth, truth.where("frame < 5"), ["seq"], "frame", "x").collect()
