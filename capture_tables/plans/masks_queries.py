"""Queries of masks and depth maps."""

from pyspark.sql import functions as F

from capture_tables.functions.shared import stored
from capture_tables.operators import masks as m
from capture_tables.plans.registry import query

_OBJ = "(SELECT * FROM fx_runs WHERE role = 'object')"
_BOX = f"(SELECT frame, min(u0) AS u_min, min(v) AS v_min, max(u1) - 1 AS u_max, max(v) AS v_max, sum(u1 - u0) AS area FROM {_OBJ} q GROUP BY frame)"


def _objects(t):
    return t("fx_runs").where("role = 'object'")


def _people(t):
    return t("fx_runs").where("role = 'person'")


@query("g1_mask_centroids", f"""SELECT frame, R6(sum((u1 - u0) * (u0 + u1 - 1) / 2e0) / sum(u1 - u0)) AS u, R6(sum((u1 - u0) * v) / sum(u1 - u0)) AS v, cast(sum(u1 - u0) as bigint) AS pixels FROM {_OBJ} o GROUP BY frame HAVING sum(u1 - u0) >= 8""")
def _(t):
    return m.mask_centroids(_objects(t), ["frame"], 8)


@query("g11_mask_geometry", f"""SELECT frame, cast(area as bigint) AS area, u_min, v_min, u_max, v_max, greatest(u_max - u_min, v_max - v_min) + 1 AS extent, u_min < 2 OR v_min < 2 OR u_max >= 62 OR v_max >= 10 AS touches,
  R6(1 - sqrt(power((u_min + u_max) / 2e0 - 315e-1, 2) + power((v_min + v_max) / 2e0 - 55e-1, 2)) / sqrt(315e-1 * 315e-1 + 55e-1 * 55e-1)) AS centrality FROM {_BOX} b""")
def _(t):
    return m.mask_geometry(_objects(t), ["frame"], 12, 64)


@query("g10_apparent_depth", f"""WITH d AS (SELECT d.frame, median(z) AS z FROM fx_depth d JOIN {_OBJ} o ON d.frame = o.frame AND d.v = o.v AND d.u >= o.u0 AND d.u < o.u1 GROUP BY d.frame),
r AS (SELECT cast(b.frame % 7 as bigint) AS seq, 500 * 3e-1 / (greatest(u_max - u_min, v_max - v_min) + 1) / z AS r FROM {_BOX} b JOIN d ON b.frame = d.frame)
SELECT seq, R6(median(r)) AS median_ratio, R6(min(r)) AS min_ratio, R6(max(r)) AS max_ratio, CASE WHEN NOT median(r) BETWEEN 85e-2 AND 115e-2 THEN 'wrong scale' WHEN max(r) - min(r) > 5e-1 THEN 'unstable' ELSE 'consistent' END AS verdict FROM r GROUP BY seq""")
def _(t):
    boxes = m.mask_geometry(_objects(t), ["frame"], 12, 64).withColumn("seq", F.col("frame") % 7)
    pixels = m.in_mask(t("fx_depth").select("frame", "v", "u", "z"), _objects(t), ["frame"])
    return m.apparent_depth_check(boxes, pixels, ["frame"], F.lit(500.0), 0.3)


@query("g12_ring_contact", """WITH px AS (SELECT DISTINCT frame, role, v, unnest(range(u0, u1)) AS u FROM fx_runs), o AS (SELECT frame, v, u FROM px WHERE role = 'object'), p AS (SELECT frame, v, u FROM px WHERE role = 'person'),
g AS (SELECT DISTINCT o.frame, o.v + dv AS v, o.u + du AS u FROM o, (SELECT unnest(range(-2, 3)) AS dv) a, (SELECT unnest(range(-2, 3)) AS du) b),
ring AS (SELECT g.* FROM g LEFT JOIN o ON g.frame = o.frame AND g.v = o.v AND g.u = o.u WHERE o.u IS NULL)
SELECT r.frame, R6(count(p.u) / count(*)) AS contact FROM ring r LEFT JOIN p ON r.frame = p.frame AND r.v = p.v AND r.u = p.u GROUP BY r.frame""")
def _(t):
    return m.ring_contact(_objects(t), _people(t), ["frame"], 2)


@query("g13_mask_shape")
def _(t):
    """The object masks of seven consecutive frames taken as one."""
    joined = _objects(t).select(F.floor(F.col("frame") / 7).alias("frame"), "v", "u0", "u1")
    return m.mask_shape(m.merge_runs(joined, ["frame"]), ["frame"])


@query("g14_rank_frames", """WITH s AS (SELECT seq, frame, (vis / max(vis) OVER w) * (z / max(z) OVER w) * (1 - conf) AS score FROM fx_obs WINDOW w AS (PARTITION BY seq))
SELECT seq, frame, R6(score) AS score, CAST(row_number() OVER (PARTITION BY seq ORDER BY round(score, 9) DESC, frame) AS INTEGER) AS "rank" FROM s""")
def _(t):
    ranked = m.rank_frames(t("fx_obs"), ["seq"], ["vis", "z"], ["conf"])
    from pyspark.sql import Window

    w = Window.partitionBy("seq").orderBy(F.round("score", 9).desc(), "frame")
    return ranked.select("seq", "frame", "score").withColumn("rank", F.row_number().over(w))


_INST = "(SELECT seq, frame // 40 AS f, frame AS instance, v, u0, u1 FROM fx_runs WHERE role = 'object')"


@query("g15_select_instance", f"""WITH c AS {_INST}, p AS (SELECT frame // 40 AS f, v, u0, u1 FROM fx_runs WHERE role = 'person' AND frame % 2 = 0), h AS (SELECT frame // 40 AS f, v, u0, u1 FROM fx_runs WHERE role = 'person' AND frame % 2 = 1),
pc AS (SELECT DISTINCT f, v, unnest(range(u0, u1)) AS u FROM p), hc AS (SELECT DISTINCT h.f, h.v + dv AS v, unnest(range(h.u0 - 1, h.u1 + 1)) AS u FROM h, (SELECT unnest(range(-1, 2)) AS dv) a),
cc AS (SELECT f, instance, v, unnest(range(u0, u1)) AS u FROM c),
s AS (SELECT cc.f, cc.instance, count(*) AS area, count(pc.u) AS prev, count(hc.u) AS near FROM cc LEFT JOIN pc ON cc.f = pc.f AND cc.v = pc.v AND cc.u = pc.u LEFT JOIN hc ON cc.f = hc.f AND cc.v = hc.v AND cc.u = hc.u GROUP BY cc.f, cc.instance),
a AS (SELECT *, CASE WHEN max(prev) OVER (PARTITION BY f) > 0 THEN 0 ELSE near END AS n2 FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY prev DESC, n2 DESC, area DESC, instance) AS k FROM a)
SELECT f, instance, CASE WHEN prev > 0 THEN 'previous' WHEN n2 > 0 THEN 'person' ELSE 'largest' END AS chosen_by FROM k WHERE k = 1""")
def _(t):
    """Masks of forty frames: objects to choose from, even people as the mask before, odd ones as the person."""
    f = F.floor(F.col("frame") / 40).alias("f")
    cands = _objects(t).select(f, F.col("frame").alias("instance"), "v", "u0", "u1")
    prev, person = (_people(t).where(F.col("frame") % 2 == k).select(f, "v", "u0", "u1") for k in (0, 1))
    return m.select_instance(cands, ["f"], prev, person, 1)


_CHUNKED = "(SELECT frame // 800 AS seq, cast((frame // 8) % 100 as int) AS frame, cast(frame % 8 as int) AS instance, role, v, u0, u1 FROM fx_runs)"


@query("g15_chained_instances", f"""WITH RECURSIVE c AS (SELECT seq, frame, frame // 4 AS chunk, instance, v, unnest(range(u0, u1)) AS u FROM {_CHUNKED} r WHERE role = 'object'),
h AS (SELECT DISTINCT seq, frame // 4 AS chunk, v + dv AS v, unnest(range(u0 - 2, u1 + 2)) AS u FROM {_CHUNKED} r, (SELECT unnest(range(-2, 3)) AS dv) a WHERE role = 'person' AND frame % 4 = 0),
s AS (SELECT c.seq, c.chunk, c.instance, count(*) AS area, count(h.u) AS near FROM c LEFT JOIN h ON h.seq = c.seq AND h.chunk = c.chunk AND h.v = c.v AND h.u = c.u WHERE c.frame % 4 = 0 GROUP BY 1, 2, 3),
w AS (SELECT *, max(near) OVER (PARTITION BY seq, chunk) AS most FROM s),
own AS (SELECT seq, chunk, instance, CASE WHEN most > 0 THEN 'person' ELSE 'largest' END AS how FROM w QUALIFY row_number() OVER (PARTITION BY seq, chunk ORDER BY CASE WHEN most > 0 THEN near ELSE area END DESC, instance) = 1),
nx AS (SELECT seq, chunk, row_number() OVER (PARTITION BY seq ORDER BY chunk) AS n, lead(chunk) OVER (PARTITION BY seq ORDER BY chunk) AS after FROM own),
l AS (SELECT seq, chunk, instance, max(frame) AS frame FROM c GROUP BY 1, 2, 3),
b AS (SELECT c.seq, nx.after AS chunk, c.instance AS before, c.v, c.u FROM c JOIN l USING (seq, chunk, instance, frame) JOIN nx ON nx.seq = c.seq AND nx.chunk = c.chunk WHERE nx.after IS NOT NULL),
o AS (SELECT b.seq, b.chunk, b.before, c.instance, count(*) AS n FROM b JOIN c ON c.seq = b.seq AND c.chunk = b.chunk AND c.v = b.v AND c.u = b.u WHERE c.frame % 4 = 0 GROUP BY 1, 2, 3, 4),
led AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY seq, chunk, before ORDER BY n DESC, instance) = 1),
chain(seq, n, chunk, instance, how) AS (SELECT own.seq, nx.n, own.chunk, own.instance, own.how FROM own JOIN nx ON nx.seq = own.seq AND nx.chunk = own.chunk WHERE nx.n = 1
  UNION ALL SELECT nx.seq, nx.n, nx.chunk, coalesce(led.instance, own.instance), CASE WHEN led.instance IS NULL THEN own.how ELSE 'previous' END
  FROM chain k JOIN nx ON nx.seq = k.seq AND nx.n = k.n + 1 JOIN own ON own.seq = nx.seq AND own.chunk = nx.chunk LEFT JOIN led ON led.seq = nx.seq AND led.chunk = nx.chunk AND led.before = k.instance)
SELECT k.seq, k.chunk, k.instance, k.how AS chosen_by, count(DISTINCT c.frame) AS frames, count(*) AS pixels FROM chain k JOIN c ON c.seq = k.seq AND c.chunk = k.chunk AND c.instance = k.instance GROUP BY 1, 2, 3, 4""")
def _(t):
    """Sequences of a hundred frames of eight orders each, followed in chunks of four frames."""
    made = t("fx_runs").select(F.floor(F.col("frame") / 800).alias("seq"), (F.floor(F.col("frame") / 8) % 100).cast("int").alias("frame"), (F.col("frame") % 8).cast("int").alias("instance"), "role", "v", "u0", "u1")
    runs = stored(made)  # read six times below
    cands = runs.where("role = 'object'").drop("role")
    chosen = m.chained_instances(cands, runs.where("role = 'person'").drop("role", "instance"), 4, 2)
    masks = m.followed_masks(cands, chosen, 4).groupBy("seq", F.floor(F.col("frame") / 4).alias("chunk"), "instance").agg(F.count_distinct("frame").alias("frames"), F.sum(F.col("u1") - F.col("u0")).cast("long").alias("pixels"))
    return chosen.join(masks, ["seq", "chunk", "instance"])


@query("g16_union_instances", """WITH px AS (SELECT DISTINCT frame % 300 AS f, v, unnest(range(u0, u1)) AS u FROM fx_runs), s AS (SELECT *, u - row_number() OVER (PARTITION BY f, v ORDER BY u) AS g FROM px)
SELECT f, v, cast(min(u) as int) AS u0, cast(max(u) + 1 as int) AS u1 FROM s GROUP BY f, v, g""")
def _(t):
    return m.union_instances(t("fx_runs").withColumn("f", F.col("frame") % 300), ["f"])


@query("g17_depth_seed", f"""WITH d AS (SELECT d.frame, count(*) AS n, median(z) AS z FROM fx_depth d JOIN {_OBJ} o ON d.frame = o.frame AND d.v = o.v AND d.u >= o.u0 AND d.u < o.u1 GROUP BY d.frame),
b AS (SELECT b.frame, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN z END AS z, (u_min + u_max) / 2e0 AS u, (v_min + v_max) / 2e0 AS v, fx, fy, cx, cy FROM {_BOX} b LEFT JOIN d ON b.frame = d.frame JOIN fx_cameras c ON c.cam = b.frame % 4)
SELECT frame, n AS pixels, R6((u - cx) * z / fx) AS x, R6((v - cy) * z / fy) AS y, R6(z) AS z FROM b""")
def _(t):
    boxes = m.mask_geometry(_objects(t), ["frame"], 12, 64).withColumn("cam", (F.col("frame") % 4).cast("int"))
    pixels = m.in_mask(t("fx_depth").select("frame", "v", "u", "z"), _objects(t), ["frame"])
    return m.depth_seed(pixels, boxes, t("fx_cameras"), ["frame"], least_px=2)


_CLEAN = """h AS (SELECT seq, g, median(z) AS h FROM d WHERE v % 2 = 0 GROUP BY seq, g), n AS (SELECT d.*, coalesce(abs(z - h) <= 2e0, false) AS near FROM d LEFT JOIN h ON d.seq = h.seq AND d.g = h.g),
a AS (SELECT * FROM (SELECT *, sum(cast(near as int)) OVER (PARTITION BY seq, g) >= 4 AS ok FROM n) q WHERE near OR NOT ok), c AS (SELECT seq, g, median(z) AS m FROM a GROUP BY seq, g),
e AS (SELECT a.*, abs(z - m) AS dv FROM a JOIN c ON a.seq = c.seq AND a.g = c.g), k AS (SELECT seq, g, median(dv) AS mad FROM e GROUP BY seq, g),
f AS (SELECT e.*, dv <= 25e-1 * mad AS inn, mad FROM e JOIN k ON e.seq = k.seq AND e.g = k.g), u AS (SELECT *, mad > 1e-6 AND sum(cast(inn as int)) OVER (PARTITION BY seq, g) >= 4 AS usable FROM f)"""


@query("g18_clean_depth", f"WITH d AS (SELECT seq, frame % 500 AS g, frame, v, u, z FROM fx_depth), {_CLEAN} SELECT frame, v, u, R6(z) AS z FROM u WHERE inn OR NOT usable")
def _(t):
    depth = t("fx_depth").withColumn("g", F.col("frame") % 500)
    return m.clean_depth(depth, depth.where("v % 2 = 0"), ["seq", "g"], 2.0, 2.5).select("frame", "v", "u", "z")


_FIT = """p AS (SELECT seq, frame, v, u, z AS p, z * 2 + 5e-1 + (frame % 3) / 50e0 AS t FROM fx_depth), m AS (SELECT seq, median(p) AS mp, median(t) AS mt FROM p GROUP BY seq),
f AS (SELECT p.seq, avg(abs(t - mt)) / avg(abs(p - mp)) AS sc, max(mt) - avg(abs(t - mt)) / avg(abs(p - mp)) * max(mp) AS sh FROM p JOIN m ON p.seq = m.seq GROUP BY p.seq)"""


def _fit(t):
    pred = t("fx_depth")
    target = pred.withColumn("z", F.col("z") * 2 + 0.5 + F.col("frame") % 3 / 50.0)
    return pred, m.fit_scale_shift(pred, target, ["seq"], ("frame", "v", "u"))


@query("g19_fit_scale_shift", f"WITH {_FIT} SELECT seq, R6(sc) AS scale, R6(sh) AS shift FROM f")
def _(t):
    return _fit(t)[1]


@query("g19_apply_scale_shift", f"WITH {_FIT} SELECT frame, v, u, R6(CASE WHEN u < 25 THEN z * sc + sh ELSE z END) AS z FROM fx_depth d JOIN f ON d.seq = f.seq")
def _(t):
    pred, fitted = _fit(t)
    return m.apply_scale_shift(pred, fitted, ["seq"], F.col("u") < 25).select("frame", "v", "u", "z")


_GRID = "grid AS (SELECT cast(frame % 40 as int) AS img, v, u, avg(z) AS z FROM fx_depth GROUP BY 1, 2, 3)"


def _grid(t):
    return t("fx_depth").groupBy((F.col("frame") % 40).cast("int").alias("img"), "v", "u").agg(F.avg("z").alias("z"))


@query("g20_erode_depth", f"""WITH {_GRID}, n AS (SELECT a.img, a.v, a.u, a.z, sum(CASE WHEN abs(a.z - b.z) <= 2e0 THEN 1 ELSE 0 END) AS good, max((least(a.v + 2, 11) - greatest(a.v - 2, 0) + 1) * (least(a.u + 2, 63) - greatest(a.u - 2, 0) + 1)) AS n
  FROM grid a JOIN grid b ON a.img = b.img AND b.v BETWEEN a.v - 2 AND a.v + 2 AND b.u BETWEEN a.u - 2 AND a.u + 2 GROUP BY a.img, a.v, a.u, a.z) SELECT img, v, u, R6(z) AS z FROM n WHERE (n - good) / n <= 8e-1""")
def _(t):
    return m.erode_depth(_grid(t), ["img"], 12, 64, most=2.0)


@query("g21_bilateral_depth", f"""WITH {_GRID}, p AS (SELECT a.img, a.v, a.u, a.z, b.z AS nz, power(a.v - b.v, 2) + power(a.u - b.u, 2) AS d2, avg(b.z) OVER (PARTITION BY a.img, a.v, a.u) AS mean FROM grid a JOIN grid b ON a.img = b.img AND b.v BETWEEN a.v - 2 AND a.v + 2 AND b.u BETWEEN a.u - 2 AND a.u + 2),
s AS (SELECT img, v, u, sum(exp(-d2 / 8e0 - power(nz - z, 2) / 2e-2) * nz) / nullif(sum(exp(-d2 / 8e0 - power(nz - z, 2) / 2e-2)), 0) AS s FROM p WHERE abs(nz - mean) < 1e0 GROUP BY img, v, u)
SELECT g.img, g.v, g.u, R6(coalesce(s, z)) AS z FROM grid g LEFT JOIN s ON g.img = s.img AND g.v = s.v AND g.u = s.u""")
def _(t):
    return m.bilateral_depth(_grid(t), ["img"], near=1.0)


@query("g22_fill_depth", f"""WITH {_GRID}, f AS (SELECT i.img, i.v, u.u, i.v * 64 + u.u AS i, g.z FROM (SELECT DISTINCT img, v FROM grid) i JOIN (SELECT cast(unnest(range(0, 64)) as int) AS u) u ON true LEFT JOIN grid g ON g.img = i.img AND g.v = i.v AND g.u = u.u),
w AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY img ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi, last_value(z IGNORE NULLS) OVER (PARTITION BY img ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pz,
  first_value(CASE WHEN z IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY img ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni, first_value(z IGNORE NULLS) OVER (PARTITION BY img ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nz FROM f)
SELECT img, v, u, R6(coalesce(z, CASE WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pz + (nz - pz) * (i - pi) / (ni - pi) END, pz, nz)) AS z FROM w""")
def _(t):
    grid = _grid(t)
    full = grid.select("img", "v").distinct().withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return m.fill_depth(full.join(grid, ["img", "v", "u"], "left"), ["img"], 64)


@query("g31_score_hypotheses", """WITH r AS (SELECT frame // 40 AS f, frame AS hyp, v, u0, u1 FROM fx_runs WHERE role = 'object'), o AS (SELECT f, v, u0, u1 FROM (SELECT *, frame // 40 AS f, min(frame) OVER (PARTITION BY frame // 40) AS first FROM fx_runs WHERE role = 'person') q WHERE frame = first),
i AS (SELECT r.f, hyp, sum(least(r.u1, o.u1) - greatest(r.u0, o.u0)) AS i FROM r JOIN o ON r.f = o.f AND r.v = o.v AND r.u0 < o.u1 AND o.u0 < r.u1 GROUP BY r.f, hyp), a AS (SELECT f, hyp, sum(u1 - u0) AS a, sum(CASE WHEN v % 2 = 0 THEN u1 - u0 ELSE 0 END) AS vis FROM r GROUP BY f, hyp), m AS (SELECT f, sum(u1 - u0) AS m FROM o GROUP BY f),
s AS (SELECT a.f, a.hyp, coalesce(i, 0) / (a + coalesce(m, 0) - coalesce(i, 0)) AS iou, vis / a AS visibility FROM a LEFT JOIN i ON a.f = i.f AND a.hyp = i.hyp LEFT JOIN m ON a.f = m.f),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY iou DESC) AS p, count(*) OVER (PARTITION BY f) AS n FROM s), b AS (SELECT *, max(CASE WHEN p = least(5, n) THEN iou END) OVER (PARTITION BY f) AS bound FROM k)
SELECT f, hyp, R6(iou) AS iou, R6(visibility) AS visibility FROM b WHERE iou >= bound""")
def _(t):
    """Hypotheses of forty frames against the first person among them."""
    from pyspark.sql import Window

    f = F.floor(F.col("frame") / 40).alias("f")
    rendered = _objects(t).select(f, F.col("frame").alias("hyp"), "v", "u0", "u1")
    people = _people(t).select(f, "frame", "v", "u0", "u1").withColumn("first", F.min("frame").over(Window.partitionBy("f")))
    mask = people.where("frame = first").select("f", "v", "u0", "u1")
    return m.score_hypotheses(rendered, rendered.where("v % 2 = 0"), mask, ["f"], 5)
