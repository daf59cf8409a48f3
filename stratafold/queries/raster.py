"""Registered queries: neighbourhoods, morphology, connected pieces and distances on pixel tables."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.functions.scalars import distance_to_segment
from stratafold.operators import components as cc
from stratafold.operators import raster as ra
from stratafold.queries.aggregates import r
from stratafold.registry import query

C = F.col
H, W = 50, 64


def at(k: str, axis: str) -> str:
    """Mirrored index of ``axis + k`` in an image of 50 x 64."""
    n = 50 if axis == "y" else 64
    return f"CASE WHEN p.{axis} + {k} < 0 THEN -1 - (p.{axis} + {k}) WHEN p.{axis} + {k} > {n - 1} THEN {2 * n - 1} - (p.{axis} + {k}) ELSE p.{axis} + {k} END"


def filtered(name: str, source: str, value: str, kernel: str) -> str:
    """Two CTEs: rows, then columns, of ``source`` weighted by ``kernel(k, w)``."""
    return (f"{name}_r AS (SELECT p.image, p.y, p.x, sum(q.{value} * w) AS v FROM {source} p, {kernel} JOIN {source} q ON q.image = p.image AND q.y = p.y AND q.x = {at('k', 'x')} GROUP BY 1, 2, 3), "
            f"{name} AS (SELECT p.image, p.y, p.x, sum(q.v * w) AS v FROM {name}_r p, {kernel} JOIN {name}_r q ON q.image = p.image AND q.x = p.x AND q.y = {at('k', 'y')} GROUP BY 1, 2, 3)")


def gauss(kernel: str, sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    return (f"{kernel} AS (SELECT k, exp(-0.5 * pow(k / {sigma}::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow(j / {sigma}::DOUBLE, 2))) FROM range({-reach}, {reach + 1}) s(j)) AS w FROM range({-reach}, {reach + 1}) t(k))")


def boxk(kernel: str, size: int) -> str:
    left = size // 2
    return f"{kernel} AS (SELECT k, 1.0::DOUBLE / {size} AS w FROM range({-left}, {size - left}) t(k))"


PX = "px AS (SELECT image, y, x, green AS v, green * green AS vv FROM pixels)"


def px(spark, folder):
    return fx.pixels(spark, folder)


def ft(spark, folder):
    return fx.framed(spark, folder)


@query("tissue_mask_r1", "pixels", f"WITH {PX}, {gauss('k1', 1.0)}, {filtered('g', 'px', 'v', 'k1')} SELECT image, y, x, round(v, 6) AS blurred, v > 0.02::DOUBLE AS tissue FROM g")
def tissue_mask(spark, folder):
    g = ra.gaussian(px(spark, folder), C("green"), 1.0, H, W, "b")
    t = ra.tissue(px(spark, folder), 1.0, 0.02, H, W).select("image", "y", "x", "tissue")
    return g.select("image", "y", "x", r("b", "blurred")).join(t, ["image", "y", "x"])


ZONES = """offs AS (SELECT a.i AS dy, b.i AS dx, sqrt(CAST(a.i * a.i + b.i * b.i AS DOUBLE)) AS d FROM range(-5, 6) a(i), range(-5, 6) b(i)),
cnt AS (SELECT count(*) FILTER (d <= 1) AS c, count(*) FILTER (d BETWEEN 2 AND 3) AS r, count(*) FILTER (d BETWEEN 4 AND 5) AS b FROM offs),
z AS (SELECT p.image, p.y, p.x, sum(q.v) FILTER (d <= 1) / any_value(c) AS c, sum(q.v) FILTER (d BETWEEN 2 AND 3) / any_value(r) AS r, sum(q.v) FILTER (d BETWEEN 4 AND 5) / any_value(b) AS b
  FROM g p, offs, cnt JOIN g q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"""
RADII = (1.0, 2.0, 3.0, 4.0, 5.0)


@query("ring_score_r2", "pixels", f"WITH {PX}, {gauss('k1', 0.5)}, {filtered('g', 'px', 'v', 'k1')}, {ZONES} SELECT image, y, x, round(least(r - c, r - b), 6) AS score FROM z")
def ring_score(spark, folder):
    return ra.ring_score(px(spark, folder), 0.5, RADII, H, W, tile=32).select("image", "y", "x", r("score", "score"))


@query("relative_bright_r3", "pixels", f"WITH {PX}, {boxk('k5', 5)}, {filtered('b', 'px', 'v', 'k5')} SELECT p.image, p.y, p.x, p.v >= 0.8::DOUBLE * b.v AND p.v >= 0.005::DOUBLE AS bright FROM px p JOIN b ON b.image = p.image AND b.y = p.y AND b.x = p.x")
def relative_bright(spark, folder):
    return ra.relative_bright(px(spark, folder), 0.8, 5, 0.005, H, W).select("image", "y", "x", "bright")


@query("dense_dark_r3", "framed", f"""WITH px AS (SELECT image, y, x, CAST(green < -0.05::DOUBLE AS INT) AS v, tissue FROM framed), {boxk('k5', 5)}, {filtered('b', 'px', 'v', 'k5')}
SELECT p.image, p.y, p.x, round(b.v, 6) >= 0.4::DOUBLE AND tissue AS dense FROM px p JOIN b ON b.image = p.image AND b.y = p.y AND b.x = p.x""")
def dense_dark(spark, folder):
    # Ten of 25 pixels are exactly the share asked for; the margin keeps them on the same side whatever the order of the sums.
    return ra.dense(ft(spark, folder), C("green") < -0.05, 5, 0.4 - 1e-9, H, W).select("image", "y", "x", "dense")


@query("texture_r3", "pixels", f"""WITH {PX}, {gauss('k1', 1.0)}, {filtered('m', 'px', 'v', 'k1')}, {filtered('q', 'px', 'vv', 'k1')}, s AS (SELECT m.image, m.y, m.x, sqrt(greatest(q.v - m.v * m.v, 0)) AS v FROM m JOIN q ON q.image = m.image AND q.y = m.y AND q.x = m.x),
{gauss('k2', 1.5)}, {filtered('t', 's', 'v', 'k2')} SELECT image, y, x, round(v, 6) AS texture FROM t""")
def texture(spark, folder):
    return ra.texture(px(spark, folder), 1.0, 1.5, H, W).select("image", "y", "x", r("texture", "texture"))


@query("valley_map_r3", "framed", f"""WITH px AS (SELECT image, y, x, green AS v FROM framed), {gauss('k1', 0.5)}, {gauss('k2', 2.0)}, {filtered('f', 'px', 'v', 'k1')}, {filtered('w', 'px', 'v', 'k2')},
d AS (SELECT f.image, f.y, f.x, w.v - f.v AS v, t.tissue FROM f JOIN w ON w.image = f.image AND w.y = f.y AND w.x = f.x JOIN framed t ON t.image = f.image AND t.y = f.y AND t.x = f.x),
c AS (SELECT image, quantile_cont(v, 0.99) - quantile_cont(v, 0.5) AS s FROM d WHERE tissue GROUP BY image), n AS (SELECT d.image, d.y, d.x, least(greatest(v / greatest(s, 1e-6::DOUBLE), 0), 2) * CAST(tissue AS INT) AS v FROM d JOIN c ON c.image = d.image)
SELECT a.image, a.y, a.x, round(max(b.v), 5) AS valley FROM n a JOIN n b ON b.image = a.image AND abs(a.y - b.y) <= 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3""")
def valley_map(spark, folder):
    return ra.valley_map(ft(spark, folder), 0.5, 2.0, H, W).select("image", "y", "x", r("valley", "valley", 5))


@query("ray_darkness_r3", "framed", """
WITH c AS (SELECT *, CAST(round_even((along + 200) / 16, 0) AS BIGINT) AS ray, CAST(round_even(across / 8, 0) AS BIGINT) AS step FROM framed WHERE across >= 0 AND along BETWEEN -200 AND 200)
SELECT image, ray, step, round(1 - min((green + 1) / 1.1::DOUBLE), 6) AS darkness FROM c GROUP BY 1, 2, 3""")
def ray_darkness(spark, folder):
    from stratafold.operators.rays import ray_cells

    return ra.ray_darkness(ray_cells(ft(spark, folder), -200.0, 200.0), (C("green") + 1) / 1.1).select("image", "ray", "step", r("darkness", "darkness"))


DETECT = """s AS (SELECT image, y, x, green AS s, y BETWEEN 3 AND 46 AS ok FROM pixels), f AS (SELECT image, quantile_cont(s, 0.8) AS floor_ FROM s WHERE ok AND y % 4 = 0 AND x % 4 = 0 GROUP BY image),
m AS (SELECT a.image, a.y, a.x, any_value(a.s) AS s, max(b.s) AS top FROM s a JOIN s b ON b.image = a.image AND b.ok AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 WHERE a.ok GROUP BY 1, 2, 3),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.image ORDER BY s DESC, y, x) AS rn FROM m JOIN f ON f.image = m.image WHERE s = top AND s > floor_)"""


@query("detect_candidates_r4", "pixels", f"WITH {DETECT} SELECT image, y, x, round(s, 6) AS score FROM k WHERE rn <= 20 + image % 5")
def detect_candidates(spark, folder):
    p = px(spark, folder).withColumn("score", C("green"))
    wanted = p.select("image").distinct().withColumn("wanted", 20 + C("image") % 5)
    return ra.detect(p, C("y").between(3, 46), 3, wanted).select("image", "y", "x", r("score", "score"))


ERODE = """d AS (SELECT image, y, x, green < 0.12::DOUBLE AS f FROM pixels), offs AS (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i) WHERE abs(a.i) + abs(b.i) <= 1),
e AS (SELECT p.image, p.y, p.x, count(*) FILTER (q.f) = 5 AS f FROM d p, offs LEFT JOIN d q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3),
o AS (SELECT p.image, p.y, p.x, bool_or(q.f) AS f FROM e p, offs JOIN e q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"""


@query("wide_gaps_r5", "pixels", f"WITH {ERODE} SELECT image, y, x, f AS gap FROM o")
def wide_gaps(spark, folder):
    return ra.wide_gaps(px(spark, folder).withColumn("dark", C("green") < 0.12), "dark", 1, H, W, "gap").select("image", "y", "x", "gap")


@query("dilation_r5", "pixels", """WITH d AS (SELECT image, y, x, green < -0.2::DOUBLE AS f FROM pixels)
SELECT a.image, a.y, a.x, bool_or(b.f) AS grown FROM d a JOIN d b ON b.image = a.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY 1, 2, 3""")
def dilation(spark, folder):
    return ra.dilated(px(spark, folder).withColumn("dark", C("green") < -0.2), "dark", 3, H, W, "grown").select("image", "y", "x", "grown")


@query("closing_r5", "pixels", """WITH d AS (SELECT image, y, x, green >= 0.08::DOUBLE AS f FROM pixels),
g AS (SELECT a.image, a.y, a.x, bool_or(b.f) AS f FROM d a JOIN d b ON b.image = a.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)
SELECT a.image, a.y, a.x, count(*) FILTER (b.f) = 9 AS closed FROM g a JOIN g b ON b.image = a.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3""")
def closing(spark, folder):
    return ra.closed(px(spark, folder).withColumn("f", C("green") >= 0.08), "f", 1, H, W, "closed").select("image", "y", "x", "closed")


def pieces(name: str, mask: str) -> str:
    """Recursive CTE: every pixel of ``mask`` (a query of image, y, x) with the first pixel of its piece in raster order."""
    return (f"{name}_m AS ({mask}), {name}(image, y, x, component) USING KEY (image, y, x) AS (SELECT image, y, x, y * 1048576 + x FROM {name}_m UNION "
            f"SELECT n.image, n.y, n.x, min(c.component) FROM {name} c, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) nb(dy, dx), recurring.{name} n "
            f"WHERE n.image = c.image AND n.y = c.y + nb.dy AND n.x = c.x + nb.dx AND c.component < n.component GROUP BY 1, 2, 3)")


MASK = "SELECT image, y, x FROM pixels WHERE green >= 0.01::DOUBLE"
BIGGEST = "big AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY image)"


def mask(spark, folder):
    return px(spark, folder).filter("green >= 0.01")


@query("components_r6", "pixels", f"WITH {pieces('c', MASK)} SELECT image, y, x, component FROM c")
def components(spark, folder):
    return cc.components(mask(spark, folder), 16)


@query("largest_piece_r6", "pixels", f"WITH {pieces('c', MASK)}, {BIGGEST} SELECT c.image, c.y, c.x FROM c JOIN big ON big.image = c.image AND big.component = c.component")
def largest_piece(spark, folder):
    return cc.largest_piece(mask(spark, folder))


@query("pieces_touching_r6", "framed", f"WITH {pieces('c', 'SELECT image, y, x FROM framed WHERE green >= 0.01::DOUBLE')}, hit AS (SELECT DISTINCT c.image, c.component FROM c JOIN framed f ON f.image = c.image AND f.y = c.y AND f.x = c.x WHERE abs(across) <= 8) "
       "SELECT c.image, c.y, c.x FROM c JOIN hit ON hit.image = c.image AND hit.component = c.component")
def pieces_touching(spark, folder):
    return cc.pieces_touching(mask(spark, folder), ft(spark, folder).filter("abs(across) <= 8"))


@query("piece_nearest_r6", "pixels", f"WITH {pieces('c', MASK)}, n AS (SELECT image, arg_min(component, ((y - 25) * (y - 25) + (x - 32) * (x - 32), y, x)) AS component FROM c GROUP BY image) SELECT c.image, c.y, c.x FROM c JOIN n ON n.image = c.image AND n.component = c.component")
def piece_nearest(spark, folder):
    return cc.piece_nearest(mask(spark, folder), (C("y") - 25) * (C("y") - 25) + (C("x") - 32) * (C("x") - 32))


@query("reachable_r6", "framed", f"""WITH {pieces('b', 'SELECT image, y, x FROM framed WHERE green < -0.02::DOUBLE')}, ob AS (SELECT DISTINCT image, component FROM b WHERE y IN (0, 49) OR x IN (0, 63)),
out AS (SELECT b.image, b.y, b.x FROM b JOIN ob ON ob.image = b.image AND ob.component = b.component), keep AS (SELECT image, y, x FROM framed f WHERE across BETWEEN 0 AND 160 AND NOT EXISTS (SELECT 1 FROM out WHERE out.image = f.image AND out.y = f.y AND out.x = f.x)),
{pieces('c', 'SELECT * FROM keep')}, hit AS (SELECT DISTINCT c.image, c.component FROM c JOIN framed f ON f.image = c.image AND f.y = c.y AND f.x = c.x WHERE across BETWEEN 0 AND 8)
SELECT c.image, c.y, c.x FROM c JOIN hit ON hit.image = c.image AND hit.component = c.component UNION ALL SELECT image, y, x FROM c WHERE image NOT IN (SELECT image FROM hit)""")
def reachable(spark, folder):
    f = ft(spark, folder)
    return cc.reachable(f.filter("across BETWEEN 0 AND 160"), f.filter("green < -0.02"), f.filter("across BETWEEN 0 AND 8"), H, W)


@query("distance_to_edge_r7", "pixels", """
WITH o AS (SELECT image, y, x FROM pixels WHERE green < -0.12::DOUBLE) SELECT p.image, p.y, p.x, min((p.y - o.y) * (p.y - o.y) + (p.x - o.x) * (p.x - o.x)) AS d2 FROM pixels p JOIN o ON o.image = p.image GROUP BY 1, 2, 3""")
def distance_to_edge(spark, folder):
    return ra.edge_distance(px(spark, folder), C("green") >= -0.12)


@query("deepest_point_r7", "pixels", """
WITH o AS (SELECT image, y, x FROM pixels WHERE green < -0.12::DOUBLE), d AS (SELECT p.image, p.y, p.x, min((p.y - o.y) * (p.y - o.y) + (p.x - o.x) * (p.x - o.x)) AS d2 FROM pixels p JOIN o ON o.image = p.image GROUP BY 1, 2, 3)
SELECT image, arg_max(y, (d2, -y, -x)) AS y, arg_max(x, (d2, -y, -x)) AS x, max(d2) AS d2, count(*) FILTER (d2 > 4) AS shrunk FROM d GROUP BY image""")
def deepest_point(spark, folder):
    d = ra.edge_distance(px(spark, folder), C("green") >= -0.12)
    return d.groupBy("image").agg(F.max_by(F.struct("y", "x", "d2"), F.struct(C("d2"), -C("y"), -C("x"))).alias("b"), F.count_if(C("d2") > 4).alias("shrunk")).select(
        "image", "b.y", "b.x", "b.d2", "shrunk")


HOLES = "hp AS (SELECT image, component, count(*) AS n, min(y) AS t, max(y) AS b, min(x) AS l, max(x) AS r FROM c GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63)"
SOLID = "SELECT image, y, x FROM pixels WHERE green < 0.05::DOUBLE"


@query("fill_holes_r8", "pixels", f"WITH {pieces('c', 'SELECT image, y, x FROM pixels WHERE green >= 0.05::DOUBLE')}, {HOLES} {SOLID} UNION ALL SELECT c.image, c.y, c.x FROM c JOIN hp ON hp.image = c.image AND hp.component = c.component")
def fill_holes(spark, folder):
    p = px(spark, folder)
    return cc.fill_holes(p.filter("green < 0.05"), p, H, W)


@query("fill_small_holes_r8", "pixels", f"WITH {pieces('c', 'SELECT image, y, x FROM pixels WHERE green >= 0.05::DOUBLE')}, {HOLES}, a AS (SELECT image, count(*) AS a FROM pixels WHERE green < 0.05::DOUBLE GROUP BY image) {SOLID} UNION ALL "
       "SELECT c.image, c.y, c.x FROM c JOIN hp ON hp.image = c.image AND hp.component = c.component JOIN a ON a.image = c.image WHERE n <= 0.002::DOUBLE * a")
def fill_small_holes(spark, folder):
    p = px(spark, folder)
    return cc.fill_holes(p.filter("green < 0.05"), p, H, W, 0.002)


STRIPS = f"""{ERODE}, gr AS (SELECT p.image, p.y, p.x, bool_or(q.f) AS f FROM o p, offs JOIN o q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3),
{pieces('c', 'SELECT d.image, d.y, d.x FROM d JOIN gr ON gr.image = d.image AND gr.y = d.y AND gr.x = d.x WHERE d.f AND NOT gr.f')}, bx AS (SELECT image, component, greatest(max(y) - min(y), max(x) - min(x)) + 1 AS len, count(*) AS n FROM c GROUP BY 1, 2)"""


def _dark(spark, folder):
    return px(spark, folder).withColumn("dark", C("green") < 0.12)


@query("long_strips_r9", "pixels", f"WITH {STRIPS} SELECT c.image, c.y, c.x FROM c JOIN bx ON bx.image = c.image AND bx.component = c.component WHERE len >= 4")
def long_strips(spark, folder):
    return ra.long_strips(_dark(spark, folder), "dark", 1, 4, H, W)


@query("shaped_strips_r9", "pixels", f"""WITH {STRIPS}, near AS (SELECT DISTINCT c.image, c.component FROM c JOIN gr ON gr.image = c.image AND gr.f AND gr.y BETWEEN c.y - 1 AND c.y + 1 AND gr.x BETWEEN c.x - 1 AND c.x + 1)
SELECT c.image, c.y, c.x FROM c JOIN bx ON bx.image = c.image AND bx.component = c.component JOIN near ON near.image = c.image AND near.component = c.component WHERE len >= 3 AND len * len >= 1.5::DOUBLE * n""")
def shaped_strips(spark, folder):
    return ra.long_strips(_dark(spark, folder), "dark", 1, 3, H, W, True, 1.5)


@query("barrier_r10", "pixels", f"WITH {STRIPS} SELECT image, y, x FROM o WHERE f UNION SELECT c.image, c.y, c.x FROM c JOIN bx ON bx.image = c.image AND bx.component = c.component WHERE len >= 4")
def barrier(spark, folder):
    from stratafold.plans.regions import black_barrier

    return black_barrier(_dark(spark, folder), {"dark": 4.0}, 1, H, W)


@query("stop_at_barrier_r10", "pixels", f"WITH {STRIPS}, bar AS (SELECT image, y, x FROM o WHERE f UNION SELECT c.image, c.y, c.x FROM c JOIN bx ON bx.image = c.image AND bx.component = c.component WHERE len >= 4), "
       f"{pieces('z', 'SELECT image, y, x FROM pixels p WHERE y BETWEEN 5 AND 44 AND NOT EXISTS (SELECT 1 FROM bar WHERE bar.image = p.image AND bar.y = p.y AND bar.x = p.x)')}, "
       "n AS (SELECT image, arg_min(component, ((y - 25) * (y - 25) + (x - 32) * (x - 32), y, x)) AS component FROM z GROUP BY image) SELECT z.image, z.y, z.x FROM z JOIN n ON n.image = z.image AND n.component = z.component")
def stop_at_barrier(spark, folder):
    from stratafold.plans.regions import black_barrier

    region = px(spark, folder).filter("y BETWEEN 5 AND 44")
    allowed = region.join(black_barrier(_dark(spark, folder), {"dark": 4.0}, 1, H, W), ["image", "y", "x"], "left_anti")
    return cc.piece_nearest(allowed, (C("y") - 25) * (C("y") - 25) + (C("x") - 32) * (C("x") - 32))


@query("strip_cuts_r10", "pixels", f"""WITH {pieces('c', 'SELECT image, y, x FROM pixels WHERE green < -0.1::DOUBLE')}, b AS (SELECT image, component, avg(y) AS ay, avg(x) AS ax, 0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)) AS t FROM c GROUP BY 1, 2 HAVING greatest(max(y) - min(y), max(x) - min(x)) + 1 >= 7),
l AS (SELECT *, -cos(t) AS ny, sin(t) AS nx, -cos(t) * (25 - ay) + sin(t) * (32 - ax) AS off FROM b)
SELECT p.image, p.y, p.x FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.image = p.image AND NOT ((ny * (p.y - ay) + nx * (p.x - ax)) * sign(off) >= least(0, abs(off) - 8)))""")
def strip_cuts(spark, folder):
    p = px(spark, folder)
    centre = p.select("image").distinct().withColumn("cy", F.lit(25.0)).withColumn("cx", F.lit(32.0))
    return cc.cut_at_strips(p, p.filter("green < -0.1"), centre, 7, 8.0)


@query("outline_r11", "pixels", """WITH m AS (SELECT image, y, x FROM pixels WHERE green >= -0.1::DOUBLE)
SELECT a.image, a.y, a.x, (a.y + a.x) % 3 = 0 AS dotted FROM m a LEFT JOIN m b ON b.image = a.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3 HAVING count(b.y) < 4""")
def outline(spark, folder):
    return ra.boundary(px(spark, folder), C("green") >= -0.1, H, W).select("image", "y", "x", ((C("y") + C("x")) % 3 == 0).alias("dotted"))


BOUND = """bd AS (SELECT a.image, a.y, a.x, any_value(a.along) AS along, any_value(a.across) AS across FROM framed a LEFT JOIN framed b ON b.image = a.image AND b.lab = 1 AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.lab = 1 GROUP BY 1, 2, 3 HAVING count(b.y) < 4)"""


@query("facing_boundary_r11", "framed", f"""WITH {BOUND}, d AS (SELECT bd.image, bd.y, bd.x, min((bd.y - o.y) * (bd.y - o.y) + (bd.x - o.x) * (bd.x - o.x)) AS d2 FROM bd JOIN framed o ON o.image = bd.image AND o.lab = 2 GROUP BY 1, 2, 3),
c AS (SELECT image, quantile_cont(sqrt(CAST(d2 AS DOUBLE)), 0.35) AS cut FROM d GROUP BY image) SELECT d.image, d.y, d.x FROM d JOIN c ON c.image = d.image WHERE sqrt(CAST(d2 AS DOUBLE)) <= cut""")
def facing_boundary(spark, folder):
    from stratafold.plans.regions import facing_boundary as facing

    return facing(ft(spark, folder), C("lab") == 1, C("lab") == 2, H, W).select("image", "y", "x")


@query("border_kinds_r11", "framed", f"""WITH {BOUND}, d AS (SELECT bd.image, bd.y, bd.x, min((bd.y - o.y) * (bd.y - o.y) + (bd.x - o.x) * (bd.x - o.x)) AS d2 FROM bd JOIN framed o ON o.image = bd.image AND o.green < -0.25::DOUBLE GROUP BY 1, 2, 3),
s AS (SELECT *, least(greatest(((y - 4) * 10 + (x - 8) * 40) / 1700.0::DOUBLE, 0), 1) AS t FROM d)
SELECT image, y, x, CASE WHEN sqrt(CAST(d2 AS DOUBLE)) <= 2 THEN 'edge' WHEN sqrt(pow(y - 4 - t * 10, 2) + pow(x - 8 - t * 40, 2)) <= 3 THEN 'line' ELSE 'interior' END AS kind FROM s""")
def border_kinds(spark, folder):
    f = ft(spark, folder)
    d = ra.edge_distance(f, C("green") >= -0.25)
    edge = ra.boundary(f, C("lab") == 1, H, W).join(d, ["image", "y", "x"])
    line = distance_to_segment(C("y"), C("x"), F.lit(4), F.lit(8), F.lit(14), F.lit(48))
    return ra.border_kinds(edge, F.sqrt("d2"), line, 2.0, 3.0).select("image", "y", "x", "kind")


@query("predicted_sides_r11", "framed", f"""WITH {BOUND} SELECT image, y, x, CASE WHEN across <= 12 THEN 'field l' WHEN along <= -112 OR along >= 112 THEN 'end cut' ELSE 'far border' END AS side FROM bd""")
def predicted_sides(spark, folder):
    b = ra.boundary(ft(spark, folder), C("lab") == 1, H, W)
    side = F.when(C("across") <= 12, "field l").when((C("along") <= -112) | (C("along") >= 112), "end cut").otherwise("far border")
    return b.select("image", "y", "x", side.alias("side"))


@query("downsample_r12", "framed", """
WITH s AS (SELECT image, CAST(floor(y * 0.4::DOUBLE) AS BIGINT) AS cy, CAST(floor(x * 0.4::DOUBLE) AS BIGINT) AS cx, avg(green) AS v, max(green) AS top, avg(CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN lab = 2 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM framed GROUP BY 1, 2, 3)
SELECT image, cy, cx, round(v, 6) AS value, round(top, 6) AS top, CASE WHEN greatest(a, b) < 0.5 THEN 0 WHEN a >= b THEN 1 ELSE 2 END AS lab FROM s""")
def downsample(spark, folder):
    return ra.downsample(ft(spark, folder), 0.4, C("green"), C("lab"), 3).select("image", "cy", "cx", r("value", "value"), r("top", "top"), "lab")


@query("bright_patch_r13", "framed", f"""WITH q AS (SELECT image, quantile_cont(green, 0.25) AS cut FROM framed WHERE tissue GROUP BY image), {pieces('c', 'SELECT f.image, f.y, f.x FROM framed f JOIN q ON q.image = f.image WHERE tissue AND green > cut')},
{BIGGEST}, k AS (SELECT c.image, c.y, c.x, count(*) OVER (PARTITION BY c.image) AS n FROM c JOIN big ON big.image = c.image AND big.component = c.component)
SELECT k.image, k.y, k.x, round(pow(f.green - q.cut, 3), 8) AS weight FROM k JOIN framed f ON f.image = k.image AND f.y = k.y AND f.x = k.x JOIN q ON q.image = k.image WHERE n >= 20""")
def bright_patch(spark, folder):
    return ra.bright_patch(ft(spark, folder), C("green"), 0.25, 20).select("image", "y", "x", r("weight", "weight", 8))


@query("contrast_stretch_r14", "framed", """WITH q AS (SELECT image, quantile_cont(green, 0.02) AS lo, quantile_cont(green, 0.98) AS hi FROM framed WHERE tissue GROUP BY image)
SELECT f.image, f.y, f.x, round((least(greatest(green, lo), hi) - lo) / greatest(hi - lo, 1e-6::DOUBLE), 6) AS stretched FROM framed f JOIN q ON q.image = f.image""")
def contrast_stretch(spark, folder):
    return ra.stretch(ft(spark, folder), C("green"), C("tissue"), 0.02, 0.98).select("image", "y", "x", r("stretched", "stretched"))


@query("editable_outline_r15", "pixels", f"""WITH {pieces('c', MASK)}, {BIGGEST}, k AS (SELECT c.image, c.y, c.x FROM c JOIN big ON big.image = c.image AND big.component = c.component)
SELECT a.image, a.y * 25.0::DOUBLE AS y, a.x * 25.0::DOUBLE AS x FROM k a LEFT JOIN k b ON b.image = a.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3 HAVING count(b.y) < 4""")
def editable_outline(spark, folder):
    from stratafold.plans.regions import editable_outline as outline_of

    return outline_of(mask(spark, folder), px(spark, folder), 25.0, H, W)
