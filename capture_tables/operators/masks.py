"""Masks as runs (v, u0, u1; half-open) and depth pixels (v, u, z) of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capture_tables.functions.shared import stored
from capture_tables.operators.grouped import over_groups, schema_of
from capture_tables.operators.joins import mask_overlap, with_dimension


def _length() -> Column:
    return F.col("u1") - F.col("u0")


def mask_centroids(runs: DataFrame, by: list[str], least_px: int) -> DataFrame:
    """by..., u, v (means over the mask's pixels), pixels; masks under the least are left out."""
    n = F.sum(_length())
    u = F.sum(_length() * (F.col("u0") + F.col("u1") - 1) / 2.0)
    v = F.sum(_length() * F.col("v"))
    out = runs.groupBy(*by).agg((u / n).alias("u"), (v / n).alias("v"), n.cast("long").alias("pixels"))
    return out.where(F.col("pixels") >= least_px)


def mask_geometry(runs: DataFrame, by: list[str], height: int, width: int, pad: int = 2) -> DataFrame:
    """by..., area, box (u_min, v_min, u_max, v_max inclusive), extent (longer side), touches the
    border within `pad`, centrality: 1 at the image centre, 0 at a corner."""
    out = runs.groupBy(*by).agg(
        F.sum(_length()).cast("long").alias("area"), F.min("u0").alias("u_min"), F.min("v").alias("v_min"), (F.max("u1") - 1).alias("u_max"), F.max("v").alias("v_max")
    )
    extent = F.greatest(F.col("u_max") - F.col("u_min"), F.col("v_max") - F.col("v_min")) + 1
    touch = (F.col("u_min") < pad) | (F.col("v_min") < pad) | (F.col("u_max") >= width - pad) | (F.col("v_max") >= height - pad)
    du = (F.col("u_min") + F.col("u_max")) / 2.0 - (width - 1) / 2.0
    dv = (F.col("v_min") + F.col("v_max")) / 2.0 - (height - 1) / 2.0
    corner = float(np.hypot((width - 1) / 2.0, (height - 1) / 2.0))
    return out.withColumn("extent", extent).withColumn("touches", touch).withColumn("centrality", 1.0 - F.sqrt(du * du + dv * dv) / corner)


def merge_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs of a row that overlap or touch, made one: by..., v, u0, u1."""
    keys = [*by, "v"]
    w = Window.partitionBy(*keys).orderBy("u0", "u1")
    reach = F.max("u1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*keys, "u0", "u1").withColumn("_new", F.coalesce((F.col("u0") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("_i", F.sum("_new").over(w))
    return island.groupBy(*keys, "_i").agg(F.min("u0").alias("u0"), F.max("u1").alias("u1")).drop("_i")


def dilate(runs: DataFrame, by: list[str], d: int) -> DataFrame:
    """The mask grown by a square of half side d; it may leave the image."""
    grown = runs.select(*by, F.explode(F.sequence(F.col("v") - d, F.col("v") + d)).alias("v"), (F.col("u0") - d).alias("u0"), (F.col("u1") + d).alias("u1"))
    return merge_runs(grown, by)


def ring_contact(objects: DataFrame, people: DataFrame, by: list[str], d: int) -> DataFrame:
    """by..., contact: share of the object's dilated ring that a person covers. The runs of both move once;
    a frame's rows are swept from edge to edge, with the number of masks of each kind that are open."""
    runs = [side.select(*by, F.lit(kind).alias("_kind"), "v", "u0", "u1").where("u0 < u1").dropna() for kind, side in enumerate((objects, people))]
    both = runs[0].unionByName(runs[1])

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first = starts[:-1]
        place = np.repeat(np.arange(len(first)), np.diff(starts))
        person = rows["_kind"].to_numpy() == 1
        line = np.stack([place, *(rows[c].to_numpy() for c in ("v", "u0", "u1"))])
        own = line[:, ~person]
        grown = np.concatenate([own + np.array([0, dv, -d, d])[:, None] for dv in range(-d, d + 1)], axis=1)
        kinds = (own, grown, line[:, person])
        edges = np.concatenate([side[[0, 1, k]] for side in kinds for k in (2, 3)], axis=1)
        kind, sign = (np.concatenate([np.full(side.shape[1], x) for k, side in enumerate(kinds) for x in pair(k)]) for pair in (lambda k: (k, k), lambda k: (1, -1)))
        turn = np.lexsort(edges[::-1])
        at, kind, sign = edges[:, turn], kind[turn], sign[turn]
        object_, near, body = (np.cumsum(np.where(kind == k, sign, 0)) > 0 for k in range(3))
        length = np.diff(at[2], append=0)  # nothing is open behind a row's last edge
        ring = near & ~object_
        count = lambda which: np.bincount(at[0][which], length[which], len(first))
        has = np.unique(own[0])
        with np.errstate(invalid="ignore"):
            contact = count(ring & body)[has] / count(ring)[has]
        return rows[by].iloc[first[has]].assign(contact=contact)

    return over_groups(both, by, ["_kind"], work, schema_of(both, by) + ", contact double")


def _hull_area(points: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Area of the convex hull of different, sorted 2-D points, and its corners, by the monotone chain."""
    if len(points) < 3:
        return 0.0, points

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = half(points) + half(points[::-1])
    twice = sum(h[k - 1][0] * h[k][1] - h[k - 1][1] * h[k][0] for k in range(len(h)))
    return abs(twice) / 2, h


def _circle(points: list[tuple[float, float]]) -> float:
    """Radius of the smallest circle around 2-D points: a point outside the circle so far lies on
    the border of the next, which is settled with the points before it."""

    def holds(c, p) -> bool:
        return c is not None and (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 <= c[2] * (1 + 1e-9) + 1e-12

    def two(p, q):
        return (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) / 4

    def three(p, q, r):
        bx, by, cx, cy = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            return max((two(p, q), two(p, r), two(q, r)), key=lambda c: c[2])
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        x, y = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        return p[0] + x, p[1] + y, x * x + y * y

    circle = None
    for i, p in enumerate(points):
        if holds(circle, p):
            continue
        circle = (p[0], p[1], 0.0)
        for j, q in enumerate(points[:i]):
            if holds(circle, q):
                continue
            circle = two(p, q)
            for r in points[:j]:
                if not holds(circle, r):
                    circle = three(p, q, r)
    return float(np.sqrt(circle[2]))


def mask_shape(runs: DataFrame, by: list[str]) -> DataFrame:
    """by..., area, solidity (area over the hull's) and fill (area over the enclosing circle's) of
    the largest connected part, rows joined where their runs overlap. The circle goes around the hull's
    corners."""

    def shape(v: list[int], a: list[int], b: list[int]) -> tuple[int, float | None, float]:
        root = list(range(len(v)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        lo = 0  # the runs of the row before start here, and end where this row starts
        row = 0
        for k in range(len(v)):
            if v[k] != v[row]:
                lo, row = row, k
            if v[lo] != v[k] - 1:
                continue
            for j in range(lo, row):
                if a[j] < b[k] and a[k] < b[j]:
                    root[find(k)] = find(j)
        area: dict[int, int] = {}
        top = [find(k) for k in range(len(v))]
        for k, t in enumerate(top):
            area[t] = area.get(t, 0) + b[k] - a[k]
        best = min(area, key=lambda t: (-area[t], t))
        size = area[best]
        corners = sorted({(float(x), float(v[k] + dv)) for k, t in enumerate(top) if t == best for x in (a[k], b[k]) for dv in (0, 1)})
        hull, border = _hull_area(corners)
        radius = _circle(border)
        return size, size / hull if hull else None, size / (np.pi * radius * radius)

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v, a, b = (rows[c].tolist() for c in ("v", "u0", "u1"))
        found = [shape(v[p:q], a[p:q], b[p:q]) for p, q in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pd.concat([rows[by].iloc[starts[:-1]].reset_index(drop=True), pd.DataFrame(found, columns=["area", "solidity", "fill"])], axis=1)

    return over_groups(runs.select(*by, "v", "u0", "u1"), by, ["v", "u0"], work, schema_of(runs, by) + ", area long, solidity double, fill double")


def rank_frames(features: DataFrame, by: list[str], gains: list[str], penalties: list[str] = (), order: str = "frame") -> DataFrame:
    """score: the product of each gain over the sequence's best and of 1 - penalty; rank from 1 by
    score, ties to the earlier frame. A sharpness enters as one more gain column."""
    w = Window.partitionBy(*by)
    score = F.lit(1.0)
    for g in gains:
        score = score * F.coalesce(F.try_divide(F.col(g), F.max(g).over(w)), F.lit(0.0))
    for p in penalties:
        score = score * (1.0 - F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))
    out = features.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), order)))


def select_instance(candidates: DataFrame, by: list[str], previous: DataFrame, person: DataFrame, d: int) -> DataFrame:
    """Of each frame's candidates (instance, v, u0, u1) the one that overlaps the previous mask
    most; if none does, the dilated person; else the largest: by..., instance, chosen_by."""
    keys = [*by, "instance"]
    area = candidates.groupBy(*keys).agg(F.sum(_length()).cast("long").alias("_area"))

    def overlap(other: DataFrame, name: str) -> DataFrame:
        right = other.select(*by, "v", F.col("u0").alias("_a"), F.col("u1").alias("_b"))
        part = F.least("u1", "_b") - F.greatest("u0", "_a")
        return candidates.join(right, [*by, "v"]).where("u0 < _b and _a < u1").groupBy(*keys).agg(F.sum(part).cast("long").alias(name))

    out = area.join(overlap(merge_runs(previous, by), "_prev"), keys, "left").join(overlap(dilate(person, by, d), "_near"), keys, "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("_prev", "_near")})
    best = F.max(F.struct("_prev", "_near", "_area", (-F.col("instance")).alias("_i")))
    # the overlap with the person only matters where no candidate meets the previous mask
    w = Window.partitionBy(*by)
    out = out.withColumn("_any", F.max("_prev").over(w) > 0).withColumn("_near", F.when(F.col("_any"), 0).otherwise(F.col("_near")))
    out = out.groupBy(*by).agg(best.alias("b"))
    how = F.when(F.col("b._prev") > 0, "previous").when(F.col("b._near") > 0, "person").otherwise("largest")
    return out.select(*by, (-F.col("b._i")).alias("instance"), how.alias("chosen_by"))


def _first_best(value: str) -> Column:
    """The instance of the greatest value in a group, the first listed of several."""
    return F.max_by("instance", F.struct(F.col(value), -F.col("instance")))


def chained_instances(candidates: DataFrame, person: DataFrame, chunk: int, d: int, by=("seq",)) -> DataFrame:
    """by..., chunk, instance, chosen_by: the instance that is followed through each chunk of frames.

    Instances are told apart within a chunk only. A chunk's is chosen among those of its first frame:
    the one that overlaps the last mask of the instance followed before most; without such an overlap
    the dilated person; without that the largest. The first listed wins ties. A chunk without masks in
    its first frame has none, and the mask before is kept for the next one.

    What each possible choice would lead to is found for all chunks at once by joins of runs; only
    these few numbers for each chunk are followed in order."""
    by = list(by)
    keys = [*by, "chunk", "instance"]
    runs = candidates.withColumn("chunk", F.floor(F.col("frame") / F.lit(chunk)).cast("long"))
    at_start = F.col("frame") == F.col("chunk") * chunk
    first = runs.where(at_start).select(*keys, "v", "u0", "u1")
    near = dilate(person.withColumn("chunk", F.floor(F.col("frame") / F.lit(chunk)).cast("long")).where(at_start), [*by, "chunk"], d)
    part = F.when(F.col("_a").isNotNull(), F.greatest(F.least("u1", "_b") - F.greatest("u0", "_a"), F.lit(0)))
    renamed = lambda df, *names: df.select(*names, "v", F.col("u0").alias("_a"), F.col("u1").alias("_b"))
    on = [*by, "chunk", "v"]
    areas = first.join(renamed(near, *by, "chunk"), on, "left")
    areas = areas.groupBy(*keys, "v", "u0", "u1").agg(F.coalesce(F.sum(part), F.lit(0)).alias("_n"))
    areas = areas.groupBy(*keys).agg(F.sum("_n").alias("_near"), F.sum(_length()).alias("_area"))
    own = areas.groupBy(*by, "chunk").agg(_first_best("_near").alias("_p"), F.max("_near").alias("_most"), _first_best("_area").alias("_l"))
    own = own.select(*by, "chunk", F.when(F.col("_most") > 0, F.col("_p")).otherwise(F.col("_l")).alias("instance"), F.when(F.col("_most") > 0, "person").otherwise("largest").alias("chosen_by"))

    following = own.select(*by, "chunk", F.lead("chunk").over(Window.partitionBy(*by).orderBy("chunk")).alias("_next"))
    lasts = runs.groupBy(*keys).agg(F.max(F.struct("frame")).alias("_at")).select(*keys, F.col("_at.frame").alias("frame"))
    before = runs.join(lasts, [*keys, "frame"]).join(following, [*by, "chunk"]).where("_next is not null")
    before = before.select(*by, F.col("_next").alias("chunk"), F.col("instance").alias("before"), "v", F.col("u0").alias("_a"), F.col("u1").alias("_b"))
    shared = first.join(before, on).groupBy(*keys, "before").agg(F.sum(part).alias("_shared")).where("_shared > 0")
    led = shared.groupBy(*by, "chunk", "before").agg(_first_best("_shared").alias("instance"))

    steps = own.select(*by, "chunk", F.lit(None).cast(candidates.schema["instance"].dataType).alias("before"), "instance", "chosen_by")
    steps = steps.unionByName(led.select(*by, "chunk", "before", "instance", F.lit("previous").alias("chosen_by")))

    def follow(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        chunks, before, instance, led_to = (rows[c].tolist() for c in ("chunk", "before", "instance", "_led"))
        picked = []
        for p, q in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            current = None
            while p < q:
                at, pick = chunks[p], -1
                while p < q and chunks[p] == at:
                    if before[p] == current if led_to[p] else pick < 0:
                        pick = p
                    p += 1
                picked.append(pick)
                current = instance[pick]
        return rows.iloc[picked][[*by, "chunk", "instance", "chosen_by"]]

    steps = steps.withColumns({"_led": F.col("before").isNotNull(), "before": F.coalesce("before", "instance")})
    return over_groups(steps, by, ["chunk", "_led"], follow, schema_of(steps, [*by, "chunk", "instance", "chosen_by"]))


def choose_instance(candidates, previous: list, person, d: int) -> tuple[int | None, str | None, list]:
    """(instance, chosen_by, its runs) of one frame, as chained_instances chooses: `candidates` have
    instance, v, u0, u1, the other masks are lists of (v, u0, u1). Without candidates the previous
    mask stays."""
    found: dict[int, list] = {}
    for r in [] if candidates is None else candidates:
        found.setdefault(int(r["instance"]), []).append((int(r["v"]), int(r["u0"]), int(r["u1"])))
    if not found:
        return None, None, previous
    grown: dict[int, list] = {}
    for r in [] if person is None else person:
        for v in range(int(r["v"]) - d, int(r["v"]) + d + 1):
            grown.setdefault(v, []).append((int(r["u0"]) - d, int(r["u1"]) + d))
    near = [(v, *r) for v, runs in grown.items() for r in _merged(runs)]
    for how, other in (("previous", previous), ("person", near)):
        shared = {k: _shared(runs, other) for k, runs in found.items()}
        best = max(sorted(shared), key=shared.get)
        if shared[best] > 0:
            return best, how, found[best]
    best = max(sorted(found), key=lambda k: sum(u1 - u0 for _, u0, u1 in found[k]))
    return best, "largest", found[best]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for u0, u1 in sorted(runs):
        if out and u0 <= out[-1][1]:
            out[-1] = (out[-1][0], max(u1, out[-1][1]))
        else:
            out.append((u0, u1))
    return out


def _shared(a: list, b: list) -> int:
    """Pixels of two masks without overlapping runs that both have."""
    rows: dict[int, list] = {}
    for v, u0, u1 in b:
        rows.setdefault(v, []).append((u0, u1))
    return sum(max(min(u1, w1) - max(u0, w0), 0) for v, u0, u1 in a for w0, w1 in rows.get(v, ()))


def _first_of(key: np.ndarray, *worth: np.ndarray) -> np.ndarray:
    """The place of each key's row of the greatest worth, the first one of several; keys ascending."""
    order = np.lexsort((*[-w for w in reversed(worth)], key))
    return order[np.flatnonzero(np.diff(key[order], prepend=-1))]


def _meeting(key: np.ndarray, runs: np.ndarray, other: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of runs (u0, u1) of one key, and the pixels that both have, where there are any; `other` ascends."""
    first = np.searchsorted(other, key)
    n = np.searchsorted(other, key, side="right") - first
    a = np.repeat(np.arange(len(key)), n)
    b = np.arange(len(a)) + np.repeat(first - np.cumsum(n) + n, n)
    both = np.minimum(runs[a, 1], others[b, 1]) - np.maximum(runs[a, 0], others[b, 0])
    hit = both > 0
    return a[hit], b[hit], both[hit]


def _merged_by(key: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_merged` for the runs of each key, sorted by key."""
    order = np.lexsort((runs[:, 0], key))
    key, runs = key[order], runs[order]
    low = runs[:, 0].min(initial=0)
    turn = np.cumsum(np.diff(key, prepend=key[:1]) != 0) * (runs[:, 1].max(initial=0) - low + 1)
    reach = np.maximum.accumulate(runs[:, 1] - low + turn)
    new = np.append(True, runs[1:, 0] - low + turn[1:] > reach[:-1])[: len(key)]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))[: len(starts)] - 1
    return key[starts], np.stack([runs[starts, 0], (reach - turn)[ends] + low], axis=1)


def choose_instances(runs: np.ndarray, frame: np.ndarray, person: np.ndarray, seen: np.ndarray, track: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """choose_instance for the frames of many tracks, each following the one before it in its track: the
    chosen instance and how (0 previous, 1 person, 2 largest) of each frame, and whether a run is of its
    frame's choice. `runs` are rows of instance, v, u0, u1 in order of `frame`, the number of their frame,
    `person` rows of v, u0, u1 in `seen`; `track` is each frame's. Every frame has runs."""
    names, own = np.unique(np.stack([frame, runs[:, 0]], axis=1), axis=0, return_inverse=True)
    own, n = own.ravel(), len(names)
    grown_v = (person[:, :1] + np.arange(-d, d + 1)).ravel()
    low, high = (f(np.append(runs[:, 1], grown_v)) for f in (np.min, np.max))
    key = lambda f, v: f * (high - low + 1) + v - low
    grown = np.repeat(person[:, 1:] + [-d, d], 2 * d + 1, axis=0)
    other, others = _merged_by(key(np.repeat(seen, 2 * d + 1), grown_v), grown)
    at, _, both = _meeting(key(frame, runs[:, 1]), runs[:, 2:], other, others)
    near = np.bincount(own[at], both, n)
    area = np.bincount(own, runs[:, 3] - runs[:, 2], n)
    by_near, by_area = _first_of(names[:, 0], near), _first_of(names[:, 0], area)
    alone, how = np.where(near[by_near] > 0, by_near, by_area), np.where(near[by_near] > 0, 1, 2)

    # what each choice leads to in the frame behind it
    goes_on = np.append(track[1:] == track[:-1], False)[frame]
    order = np.flatnonzero(goes_on)[np.argsort(key(frame[goes_on] + 1, runs[goes_on, 1]), kind="stable")]
    a, b, both = _meeting(key(frame, runs[:, 1]), runs[:, 2:], key(frame[order] + 1, runs[order, 1]), runs[order, 2:])
    pair, place = np.unique(own[order][b] * n + own[a], return_inverse=True)
    best = _first_of(pair // n, np.bincount(place.ravel(), both, len(pair)))
    leads = np.full(n, -1)
    leads[pair[best] // n] = pair[best] % n

    # all tracks take their k-th step together
    starts = np.flatnonzero(np.diff(track, prepend=-1))
    length, chosen = np.diff(np.append(starts, len(track))), alone.copy()
    for k in range(1, int(length.max(initial=0))):
        i = starts[length > k] + k
        led = leads[chosen[i - 1]]
        chosen[i], how[i] = np.where(led >= 0, led, alone[i]), np.where(led >= 0, 0, how[i])
    return names[chosen, 1], how, chosen[frame] == own


def followed_masks(candidates: DataFrame, chosen: DataFrame, chunk: int, by=("seq",)) -> DataFrame:
    """The runs of each chunk's chosen instance in all its frames."""
    runs = candidates.withColumn("chunk", F.floor(F.col("frame") / F.lit(chunk)).cast("long"))
    return runs.join(chosen.select(*by, "chunk", "instance"), [*by, "chunk", "instance"]).drop("chunk")


def union_instances(candidates: DataFrame, by: list[str]) -> DataFrame:
    """All instances of a frame as one mask."""
    return merge_runs(candidates, by)


def score_hypotheses(rendered: DataFrame, visible: DataFrame, mask: DataFrame, by: list[str], keep: int = 31) -> DataFrame:
    """by..., hyp, iou of the rendered mask with the observed one, visibility (visible over full
    rendered area); those at least as good as the keep-th best of the frame."""
    from capture_tables.operators.ranking import keep_kth

    keys = [*by, "hyp"]
    area = lambda df, n: df.groupBy(*keys).agg(F.sum(_length()).cast("long").alias(n))
    right = mask.select(*by, "v", F.col("u0").alias("_a"), F.col("u1").alias("_b"))
    part = F.least("u1", "_b") - F.greatest("u0", "_a")
    shared = rendered.join(right, [*by, "v"]).where("u0 < _b and _a < u1").groupBy(*keys).agg(F.sum(part).cast("long").alias("_i"))
    seen = mask.groupBy(*by).agg(F.sum(_length()).cast("long").alias("_m"))
    out = area(rendered, "_full").join(area(visible, "_vis"), keys, "left").join(shared, keys, "left").join(seen, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    iou = F.try_divide(zero("_i"), F.col("_full") + zero("_m") - zero("_i"))
    out = out.select(*keys, F.coalesce(iou, F.lit(0.0)).alias("iou"), F.coalesce(F.try_divide(zero("_vis"), F.col("_full")), F.lit(0.0)).alias("visibility"))
    return keep_kth(out, "iou", keep, by)


def in_mask(depth: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Depth pixels that lie in a run of the mask, each once; merged runs do not overlap."""
    right = merge_runs(runs, by)
    return depth.join(right, [*by, "v"]).where("u >= u0 and u < u1").drop("u0", "u1")


def apparent_depth_check(boxes: DataFrame, depth: DataFrame, by: list[str], focal: Column, diameter: float, within=(0.85, 1.15), spread: float = 0.5, least_px: int = 1) -> DataFrame:
    """For each seq the median, smallest and largest ratio of f D / extent to the median depth in
    the mask, and a verdict. `boxes` has by..., extent; `depth` the mask's own pixels."""
    middle = depth.groupBy(*by).agg(F.median("z").alias("_z"), F.count("*").alias("_n")).where(F.col("_n") >= least_px)
    ratio = boxes.join(middle, by).select("seq", (focal * diameter / F.col("extent") / F.col("_z")).alias("_r"))
    out = ratio.groupBy("seq").agg(F.median("_r").alias("median_ratio"), F.min("_r").alias("min_ratio"), F.max("_r").alias("max_ratio"))
    wide = (F.col("max_ratio") - F.col("min_ratio")) > spread
    verdict = F.when(~F.col("median_ratio").between(*within), "wrong scale").when(wide, "unstable").otherwise("consistent")
    return out.withColumn("verdict", verdict)


def depth_seed(depth: DataFrame, boxes: DataFrame, cameras: DataFrame, by: list[str], least_px: int = 4) -> DataFrame:
    """by..., pixels, x, y, z: the box centre back-projected at the median valid depth of the
    mask's pixels; NULL where there are fewer than the least. `boxes` has by..., cam and the box."""
    middle = depth.groupBy(*by).agg(F.count("*").alias("pixels"), F.median("z").alias("_z"))
    out = boxes.join(middle, by, "left").join(cameras.select("cam", "fx", "fy", "cx", "cy"), "cam")
    z = F.when(F.col("pixels") >= least_px, F.col("_z"))
    u, v = (F.col("u_min") + F.col("u_max")) / 2.0, (F.col("v_min") + F.col("v_max")) / 2.0
    return out.select(*by, F.coalesce("pixels", F.lit(0)).alias("pixels"), ((u - F.col("cx")) * z / F.col("fx")).alias("x"), ((v - F.col("cy")) * z / F.col("fy")).alias("y"), z.alias("z"))


def clean_depth(depth: DataFrame, human: DataFrame, by: list[str], band: float, k: float, least_px: int = 4) -> DataFrame:
    """Pixels within `band` of the person's median depth, if the least remain, then within k median
    absolute deviations of their median, if that is over 1e-6 and the least remain."""
    middle = human.groupBy(*by).agg(F.median("z").alias("_h"))
    near = depth.join(middle, by, "left").withColumn("_near", F.coalesce(F.abs(F.col("z") - F.col("_h")) <= band, F.lit(False)))
    w = Window.partitionBy(*by)
    enough = F.sum(F.col("_near").cast("int")).over(w) >= least_px
    first = near.withColumn("_ok", enough).where("_near or not _ok").drop("_near", "_ok", "_h")
    centre = first.groupBy(*by).agg(F.median("z").alias("_m"))
    apart = first.join(centre, by).withColumn("_d", F.abs(F.col("z") - F.col("_m")))
    mad = apart.groupBy(*by).agg(F.median("_d").alias("_mad"))
    tight = apart.join(mad, by).withColumn("_in", F.col("_d") <= k * F.col("_mad"))
    use = (F.col("_mad") > 1e-6) & (F.sum(F.col("_in").cast("int")).over(w) >= least_px)
    return tight.withColumn("_use", use).where("_in or not _use").select(*depth.columns)


def large_medians(df: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """by... and the exact median of each column under its new name, of groups of any size: approximate
    quantiles on both sides of the middle leave a hundredth of a group's values to be counted and ranked, and
    how many lie below them. NaN counts as the largest, and has all of its group's values ranked."""
    part = lambda n: F.struct(F.lit(n).alias("c"), F.col(n).cast("double").alias("v"))
    long = df.select(*by, F.explode(F.array(*map(part, names))).alias("_p")).select(*by, "_p.c", "_p.v").where("v is not null")
    some = F.bool_or(F.isnan("v"))
    ends = F.percentile_approx(F.when(~F.isnan("v"), F.col("v")), [0.495, 0.505], 10000)
    bound = [F.when(~some, ends[0]).otherwise(float("-inf")).alias("lo"), F.when(~some, ends[1]).otherwise(float("nan")).alias("hi")]
    bounds = stored(long.groupBy(*by, "c").agg(*bound, F.count("*").alias("n")))
    near = with_dimension(long, bounds, [*by, "c"]).where("v <= hi").withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
    counted = near.groupBy(*by, "c", "n", "v").agg(F.count("*").alias("k"))  # v is null below the bound, and sorts first
    ranked = counted.withColumn("to", F.sum("k").over(Window.partitionBy(*by, "c").orderBy("v")))
    at = lambda rank: F.max(F.when((F.col("to") - F.col("k") <= rank) & (rank < F.col("to")), F.col("v")))
    pair = ranked.groupBy(*by, "c").agg(at(F.floor((F.col("n") - 1) / 2)).alias("a"), at(F.floor(F.col("n") / 2)).alias("b"))
    middle = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a median lies outside its bounds")).cast("double")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5)
    return pair.groupBy(*by).agg(*[F.max(F.when(F.col("c") == n, middle)).alias(to) for n, to in names.items()])


def fit_scale_shift(predicted: DataFrame, target: DataFrame, by: list[str], pixel=("v", "u")) -> DataFrame:
    """by..., scale, shift from medians and mean absolute deviations over common pixels:
    scale = dev(target) / dev(predicted), shift = med(target) - scale * med(predicted)."""
    both = predicted.select(*by, *pixel, F.col("z").alias("p")).join(target.select(*by, *pixel, F.col("z").alias("t")), [*by, *pixel])
    both = stored(both.select(*by, "p", "t"))
    med = stored(large_medians(both, by, {"p": "_mp", "t": "_mt"}))
    dev = with_dimension(both, med, by).groupBy(*by, "_mp", "_mt").agg(F.avg(F.abs(F.col("p") - F.col("_mp"))).alias("_dp"), F.avg(F.abs(F.col("t") - F.col("_mt"))).alias("_dt"))
    scale = F.try_divide(F.col("_dt"), F.col("_dp"))
    return stored(dev.select(*by, scale.alias("scale"), (F.col("_mt") - scale * F.col("_mp")).alias("shift")))


def apply_scale_shift(depth: DataFrame, fitted: DataFrame, by: list[str], inside: Column | None = None) -> DataFrame:
    """z scaled and shifted, on pixels where `inside` holds; groups without a fit stay."""
    out = with_dimension(depth, fitted, by, "left")
    new = F.coalesce(F.col("z") * F.col("scale") + F.col("shift"), F.col("z"))
    return out.withColumn("z", new if inside is None else F.when(inside, new).otherwise(F.col("z"))).drop("scale", "shift")


#: Pixels along a tile's side.
TILE = 32


def _on_tiles(depth: DataFrame, by: list[str], radius: int, work) -> DataFrame:
    """Pixels by square tiles, each with a border of `radius`, so that a pixel is sent once, or two or
    four times near an edge. `work` gets the (2 radius + 1)-squares around a tile's places, NaN where no
    pixel is, and the places' v and u; it gives which pixels stay, and their z."""
    at = lambda c: F.sequence(F.floor((F.col(c) - radius) / TILE), F.floor((F.col(c) + radius) / TILE))
    sent = depth.withColumn("_tv", F.explode(at("v"))).withColumn("_tu", F.explode(at("u")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v0, u0 = (int(rows[c].iloc[0]) * TILE for c in ("_tv", "_tu"))
        v, u = rows["v"].to_numpy() - v0, rows["u"].to_numpy() - u0
        image = np.full((TILE + 2 * radius, TILE + 2 * radius), np.nan)
        image[v + radius, u + radius] = rows["z"].to_numpy(float)
        own = (v >= 0) & (v < TILE) & (u >= 0) & (u < TILE)
        kept, z = work(np.lib.stride_tricks.sliding_window_view(image, (2 * radius + 1, 2 * radius + 1)), v0 + np.arange(TILE)[:, None], u0 + np.arange(TILE)[None])
        own[own] = kept[v[own], u[own]]
        return rows[own].drop(columns=["_tv", "_tu"]).assign(z=z[v[own], u[own]])

    return sent.groupBy(*by, "_tv", "_tu").applyInPandas(run, depth.withColumn("z", F.col("z").cast("double")).schema)


def erode_depth(depth: DataFrame, by: list[str], height: int, width: int, radius: int = 2, most: float = 0.001, share: float = 0.8) -> DataFrame:
    """Pixels without those of whose neighbours inside the image more than the share are invalid
    (have no row) or differ by more than `most`."""

    def work(near: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = near[:, :, radius, radius]
        good = (np.abs(near - z[:, :, None, None]) <= most).sum(axis=(2, 3))
        span = lambda c, n: np.minimum(c + radius, n - 1) - np.maximum(c - radius, 0) + 1
        n = np.maximum(span(v, height) * span(u, width), 1)
        return (n - good) / n <= share, z

    return _on_tiles(depth.select(*by, "v", "u", "z"), by, radius, work)


def bilateral_depth(depth: DataFrame, by: list[str], radius: int = 2, near: float = 0.01, sigma_d: float = 2.0, sigma_r: float = 0.1) -> DataFrame:
    """z as the mean of neighbours within `near` of the local mean, weighted by the distance in the
    image and in depth from the pixel; a pixel without such neighbours keeps its z."""
    step = np.arange(-radius, radius + 1) ** 2
    apart = (step[:, None] + step[None]) / (2.0 * sigma_d * sigma_d)

    def work(around: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, there = around[:, :, radius, radius], ~np.isnan(around)
        value = np.where(there, around, 0.0)
        mean = value.sum(axis=(2, 3)) / np.maximum(there.sum(axis=(2, 3)), 1)
        used = there & (np.abs(value - mean[:, :, None, None]) < near)
        weight = np.where(used, np.exp(-apart - (value - np.nan_to_num(z)[:, :, None, None]) ** 2 / (2.0 * sigma_r * sigma_r)), 0.0)
        total = weight.sum(axis=(2, 3))
        smooth = (weight * value).sum(axis=(2, 3)) / np.where(total > 0, total, 1.0)
        return np.ones(z.shape, bool), np.where(total > 0, smooth, z)

    return _on_tiles(depth, by, radius, work)


def fill_depth(grid: DataFrame, by: list[str], width: int) -> DataFrame:
    """z of a full grid (NULL where unknown) filled along the rows' flat index by straight lines
    between known pixels; before the first and behind the last their values."""
    at = F.col("v") * width + F.col("u")
    out = grid.withColumn("_i", at)
    w = Window.partitionBy(*by).orderBy("_i")
    known = F.when(F.col("z").isNotNull(), F.struct("_i", "z"))
    out = out.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*by).orderBy(F.desc("_i"))
    out = out.withColumn("_n", F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.try_divide(F.col("_i") - F.col("_p._i"), F.col("_n._i") - F.col("_p._i"))
    line = F.col("_p.z") + (F.col("_n.z") - F.col("_p.z")) * t
    return out.withColumn("z", F.coalesce(F.col("z"), line, F.col("_p.z"), F.col("_n.z"))).drop("_i", "_p", "_n")
