"""Registered queries: composite region rules."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.operators import frames, polygons
from stratafold.plans import fits
from stratafold.plans import regions as rg
from stratafold.queries.aggregates import DIRECTIONS, r
from stratafold.queries.profiles import _ends_sql, depth_sql
from stratafold.queries.raster import BOUND, ERODE, filtered, gauss, pieces
from stratafold.registry import query

C = F.col
H, W = 50, 64


def ft(spark, folder):
    return fx.framed(spark, folder)


def bands(spark, folder):
    return fx.bands(spark, folder)


def finish(name: str, mask: str, frame: str = "SELECT image, y, x FROM framed") -> str:
    """CTEs for holes filled and the largest piece of ``mask``; the frame is the image's whole pixel set."""
    return (f"{name}_i AS (SELECT DISTINCT image, y, x FROM ({mask})), {name}_f AS ({frame}), "
            f"{pieces(name + '_o', f'SELECT image, y, x FROM {name}_f p WHERE NOT EXISTS (SELECT 1 FROM {name}_i i WHERE i.image = p.image AND i.y = p.y AND i.x = p.x)')}, "
            f"{name}_h AS (SELECT image, component FROM {name}_o GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63), "
            f"{name}_u AS (SELECT * FROM {name}_i UNION ALL SELECT o.image, o.y, o.x FROM {name}_o o JOIN {name}_h h ON h.image = o.image AND h.component = o.component), "
            f"{pieces(name + '_p', f'SELECT * FROM {name}_u')}, {name}_b AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM {name}_p GROUP BY 1, 2) GROUP BY image), "
            f"{name} AS (SELECT p.image, p.y, p.x FROM {name}_p p JOIN {name}_b b ON b.image = p.image AND b.component = p.component)")


def parts(count: int) -> str:
    return f"SELECT image * {count} + k AS image, y, x FROM framed, range(0, {count}) t(k)"


AXIS = """c AS (SELECT image, avg(y) AS cy, avg(x) AS cx FROM framed WHERE lab = 1 GROUP BY image), ax AS (SELECT c.*, CASE WHEN normal_y * (2 - cy) + normal_x * (60 - cx) < 0 THEN -normal_y ELSE normal_y END AS ay,
  CASE WHEN normal_y * (2 - cy) + normal_x * (60 - cx) < 0 THEN -normal_x ELSE normal_x END AS ax FROM c JOIN bands b ON b.image = c.image),
m AS (SELECT f.image, (min((y - cy) * ay + (x - cx) * ax) + max((y - cy) * ay + (x - cx) * ax)) / 2 AS mid FROM framed f JOIN ax ON ax.image = f.image WHERE lab = 1 GROUP BY 1)"""


def _axis(spark, folder):
    f = ft(spark, folder)
    b = bands(spark, folder).select("image", C("normal_y").alias("dir_y"), C("normal_x").alias("dir_x"))
    marker = b.select("image", F.lit(2).alias("y"), F.lit(60).alias("x"))
    return polygons.halving_axis(f.filter("lab = 1"), b, marker, "image")


@query("halved_region_g1", "framed bands", f"WITH {AXIS} SELECT f.image, y, x, CASE WHEN (y - cy) * ay + (x - cx) * ax >= mid THEN 'dNCM' ELSE 'vNCM' END AS half FROM framed f JOIN ax ON ax.image = f.image JOIN m ON m.image = f.image WHERE lab = 1")
def halved_region(spark, folder):
    return polygons.split_halves(ft(spark, folder).filter("lab = 1"), _axis(spark, folder), "image")


@query("resolved_regions_g1", "framed bands", f"""WITH {AXIS} SELECT f.image, CASE WHEN lab = 2 THEN 'CMM' WHEN lab = 0 THEN 'HP' WHEN (y - cy) * ay + (x - cx) * ax >= mid THEN 'dNCM' ELSE 'vNCM' END AS region, count(*) AS n
FROM framed f JOIN ax ON ax.image = f.image JOIN m ON m.image = f.image GROUP BY 1, 2""")
def resolved_regions(spark, folder):
    named = ft(spark, folder).withColumn("name", F.when(C("lab") == 1, "NCM").when(C("lab") == 2, "CMM").otherwise("HP"))
    return rg.resolved_regions(named, _axis(spark, folder)).groupBy("image", "region").agg(F.count("*").alias("n"))


BAND = f"""WITH px AS (SELECT image, y, x, green AS v FROM framed), {gauss('k1', 1.0)}, {filtered('g', 'px', 'v', 'k1')}, sm AS (SELECT g.image, g.y, g.x, g.v, f.tissue FROM g JOIN framed f ON f.image = g.image AND f.y = g.y AND f.x = g.x),
q AS (SELECT image, quantile_cont(v, 0.25) AS cut FROM sm WHERE tissue GROUP BY image), {pieces('c', 'SELECT sm.image, sm.y, sm.x FROM sm JOIN q ON q.image = sm.image WHERE tissue AND v > cut')},
big AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY image),
pt AS (SELECT c.image, c.y, c.x, pow(sm.v - cut, 3) AS w FROM c JOIN big ON big.image = c.image AND big.component = c.component JOIN sm ON sm.image = c.image AND sm.y = c.y AND sm.x = c.x JOIN q ON q.image = c.image),
a AS (SELECT image, degrees(0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y))) AS a, sum(w) AS sw, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * y * y) / sum(w) AS yy, sum(w * x * x) / sum(w) AS xx, sum(w * y * x) / sum(w) AS yx FROM pt GROUP BY image HAVING count(*) >= 20),
b AS (SELECT image, a, degrees(0.5 * atan2(2 * (yx - my * mx), (xx - mx * mx) - (yy - my * my))) AS b FROM a), d AS (SELECT image, CASE WHEN abs((b - a + 90) - 180 * floor((b - a + 90) / 180) - 90) <= 45 THEN b ELSE a END AS d FROM b),
n AS (SELECT image, -cos(radians(d)) AS ny, sin(radians(d)) AS nx FROM d), s AS (SELECT pt.image, quantile_cont(ny * (y - 25) + nx * (x - 32), 0.1) AS lo, quantile_cont(ny * (y - 25) + nx * (x - 32), 0.9) AS hi FROM pt JOIN n ON n.image = pt.image GROUP BY 1),
o AS (SELECT n.image, CASE WHEN ny * (2 - 25) + nx * (60 - 32) > (lo + hi) / 2 THEN ny ELSE -ny END AS ny, CASE WHEN ny * (2 - 25) + nx * (60 - 32) > (lo + hi) / 2 THEN nx ELSE -nx END AS nx FROM n JOIN s ON s.image = n.image),
e AS (SELECT pt.image, any_value(ny) AS ny, any_value(nx) AS nx, quantile_cont(ny * (y - 25) + nx * (x - 32), 0.9) AS off, quantile_cont(-nx * (y - 25) + ny * (x - 32), 0.1) AS sl, quantile_cont(-nx * (y - 25) + ny * (x - 32), 0.9) AS sh FROM pt JOIN o ON o.image = pt.image GROUP BY 1)
"""


def _found(spark, folder):
    markers = ft(spark, folder).select("image").distinct().withColumn("marker_y", F.lit(2)).withColumn("marker_x", F.lit(60))
    return rg.find_band(ft(spark, folder), markers, H, W, 1.0, 0.25, 20, 160.0)


@query("find_band_g2", "framed", BAND + "SELECT image, round(ny, 5) AS normal_y, round(nx, 5) AS normal_x, round(off, 4) AS ncm_offset, round(off - 20, 4) AS cmm_offset, round(sl, 4) AS span_low, round(sh, 4) AS span_high FROM e")
def find_band(spark, folder):
    return _found(spark, folder).select("image", r("normal_y", "normal_y", 5), r("normal_x", "normal_x", 5), *[r(n, n, 4) for n in ("ncm_offset", "cmm_offset", "span_low", "span_high")])


@query("standard_boxes_g3", "framed bands", f"""WITH w AS (SELECT image, (ncm_offset - cmm_offset) * 8 AS w FROM bands), t AS (SELECT f.*, w FROM framed f JOIN w ON w.image = f.image WHERE tissue),
b AS (SELECT image, max(-w - across) AS reach, max(along) - min(along) AS span, avg(along) AS mid FROM t WHERE across < -w GROUP BY image),
mk AS (SELECT image * 2 AS image, y, x FROM t WHERE across > 0 AND across < 120 AND abs(along) <= 150 UNION ALL SELECT t.image * 2 + 1, y, x FROM t JOIN b ON b.image = t.image WHERE across < -w AND -w - across < 0.5::DOUBLE * reach AND abs(along - 0.5::DOUBLE * mid) <= 0.46::DOUBLE * span / 2),
{finish('z', 'SELECT * FROM mk', parts(2))} SELECT image // 2 AS image, CAST(image % 2 AS INT) AS part, y, x FROM z""")
def standard_boxes(spark, folder):
    return rg.standard_boxes(ft(spark, folder), bands(spark, folder), 120.0, 300.0, 0.5, 0.46, 0.5, H, W)


@query("fixed_baseline_g3", "pixels", "SELECT image, count(*) FILTER (green >= 0 AND -(x - 32) > 0) AS near_side, count(*) FILTER (green >= 0 AND -(x - 32) < 0) AS far_side FROM pixels GROUP BY image")
def fixed_baseline(spark, folder):
    ny, nx = F.lit(0.0), F.lit(-1.0)
    signed = frames.signed_distance(ny, nx, H, W)
    return fx.pixels(spark, folder).groupBy("image").agg(
        F.count_if((C("green") >= 0) & (signed > 0)).alias("near_side"), F.count_if((C("green") >= 0) & (signed < 0)).alias("far_side"))


@query("ladder_g4", "framed", f"""WITH {BOUND}, fd AS (SELECT bd.image, bd.y, bd.x, sqrt(CAST(min((bd.y - o.y) * (bd.y - o.y) + (bd.x - o.x) * (bd.x - o.x)) AS DOUBLE)) AS d FROM bd JOIN framed o ON o.image = bd.image AND o.lab = 2 GROUP BY 1, 2, 3),
fc AS (SELECT fd.* FROM fd JOIN (SELECT image, quantile_cont(d, 0.35) AS cut FROM fd GROUP BY image) q ON q.image = fd.image WHERE d <= cut),
l AS (SELECT image, avg(y) AS cy, avg(x) AS cx, 0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)) AS t FROM fc GROUP BY image),
ed AS (SELECT p.image, p.y, p.x, min((p.y - o.y) * (p.y - o.y) + (p.x - o.x) * (p.x - o.x)) AS d2 FROM framed p JOIN framed o ON o.image = p.image AND o.lab <> 1 WHERE p.lab = 1 GROUP BY 1, 2, 3),
dp AS (SELECT image, arg_max(y, (d2, -y, -x)) AS py, arg_max(x, (d2, -y, -x)) AS px FROM ed GROUP BY image),
rw AS (SELECT f.*, sin(t) * (y - cy) + cos(t) * (x - cx) AS a, sin(t) * (x - cx) - cos(t) * (y - cy) AS c, CASE WHEN sin(t) * (px - cx) - cos(t) * (py - cy) > 0 THEN 1 ELSE -1 END AS side FROM framed f JOIN l ON l.image = f.image JOIN dp ON dp.image = f.image),
e AS (SELECT image, quantile_cont(a, 0.005) AS lo, quantile_cont(a, 0.995) AS hi, quantile_cont(c, 0.5) AS m, quantile_cont(CASE WHEN lab = 1 THEN c END, 0.995) AS chi, quantile_cont(c, 0.005) AS clo FROM rw WHERE lab = 1 GROUP BY image),
k AS (SELECT rw.*, a <= hi AS far, a >= lo AS low, CASE WHEN m < 0 THEN -c <= -clo ELSE c <= chi END AS cut FROM rw JOIN e ON e.image = rw.image WHERE tissue AND c * side > 0),
mk AS (SELECT image * 4 AS image, y, x FROM k UNION ALL SELECT image * 4 + 1, y, x FROM k WHERE far UNION ALL SELECT image * 4 + 2, y, x FROM k WHERE far AND low UNION ALL SELECT image * 4 + 3, y, x FROM k WHERE far AND low AND cut),
{finish('z', 'SELECT * FROM mk', parts(4))} SELECT image // 4 AS image, CAST(image % 4 AS INT) AS part, y, x FROM z""")
def ladder(spark, folder):
    return rg.ladder(ft(spark, folder), C("lab") == 1, C("lab") == 2, H, W)


SOLID = f"""{pieces('t', 'SELECT image, y, x FROM framed WHERE tissue')}, tb AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY image),
bg AS (SELECT t.image, t.y, t.x FROM t JOIN tb ON tb.image = t.image AND tb.component = t.component),
dl AS (SELECT DISTINCT f.image, f.y, f.x FROM framed f JOIN bg ON bg.image = f.image AND bg.y BETWEEN f.y - 1 AND f.y + 1 AND bg.x BETWEEN f.x - 1 AND f.x + 1),
cl AS (SELECT f.image, f.y, f.x FROM framed f JOIN dl ON dl.image = f.image AND dl.y BETWEEN f.y - 1 AND f.y + 1 AND dl.x BETWEEN f.x - 1 AND f.x + 1 GROUP BY 1, 2, 3 HAVING count(*) = 9),
{pieces('u', 'SELECT image, y, x FROM framed p WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.image = p.image AND cl.y = p.y AND cl.x = p.x)')}, uh AS (SELECT image, component FROM u GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63),
sol AS (SELECT * FROM cl UNION ALL SELECT u.image, u.y, u.x FROM u JOIN uh ON uh.image = u.image AND uh.component = u.component)"""


@query("solid_tissue_r5", "framed", f"WITH {SOLID} SELECT * FROM sol")
def solid_tissue(spark, folder):
    return rg.solid_tissue(ft(spark, folder), 1, H, W)


@query("by_the_rule_g5", "framed", f"""WITH {SOLID}, en AS (SELECT image, (min(along) + max(along)) / 2 AS mid, least(greatest(max(along) - min(along), 250), 320) AS span FROM framed WHERE lab = 1 GROUP BY image),
{finish('z', 'SELECT f.image, f.y, f.x FROM sol s JOIN framed f ON f.image = s.image AND f.y = s.y AND f.x = s.x JOIN en ON en.image = f.image WHERE across >= 0 AND along BETWEEN mid - span / 2 AND mid + span / 2')} SELECT * FROM z""")
def by_the_rule(spark, folder):
    f = ft(spark, folder)
    return rg.by_the_rule(f, rg.ends_from(f.filter("lab = 1"), 250.0, 320.0), 1, H, W)


SMALL = "o_a AS (SELECT image, count(*) AS a FROM sp GROUP BY image)"


def small_holes(share: float) -> str:
    return (f"{pieces('o', 'SELECT image, y, x FROM framed p WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.image = p.image AND sp.y = p.y AND sp.x = p.x)')}, oh AS (SELECT image, component, count(*) AS n FROM o GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63), {SMALL} "
            f"SELECT * FROM sp UNION ALL SELECT o.image, o.y, o.x FROM o JOIN oh ON oh.image = o.image AND oh.component = o.component JOIN o_a ON o_a.image = o.image WHERE n <= {share}::DOUBLE * a")


@query("stopped_at_gap_g6", "framed", f"""WITH c AS (SELECT *, CAST(round_even((along + 3000) / 16, 0) AS BIGINT) AS ray, CAST(round_even(across / 8, 0) AS BIGINT) AS step FROM framed WHERE across >= 0 AND abs(along) <= 160),
g AS (SELECT image, ray, min(step) AS s FROM c WHERE green < -0.22::DOUBLE GROUP BY 1, 2), kp AS (SELECT c.image, c.y, c.x FROM c LEFT JOIN g ON g.image = c.image AND g.ray = c.ray WHERE g.s IS NULL OR c.step < g.s),
{pieces('k', 'SELECT * FROM kp')}, kb AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY image), sp AS (SELECT k.image, k.y, k.x FROM k JOIN kb ON kb.image = k.image AND kb.component = k.component),
""" + small_holes(0.2))
def stopped_at_gap(spark, folder):
    return rg.stopped_at_first_gap(ft(spark, folder), (C("across") >= 0) & (F.abs("along") <= 160), C("green") < -0.22, 0.2, H, W)


@query("stopped_at_black_g6", "framed", f"""WITH {pieces('k', 'SELECT image, y, x FROM framed WHERE across >= 0 AND abs(along) <= 160 AND tissue')},
sd AS (SELECT k.image, arg_min(k.component, (across + 0.001::DOUBLE * abs(along), k.y, k.x)) AS component FROM k JOIN framed f ON f.image = k.image AND f.y = k.y AND f.x = k.x GROUP BY 1), sp AS (SELECT k.image, k.y, k.x FROM k JOIN sd ON sd.image = k.image AND sd.component = k.component),
""" + small_holes(0.05))
def stopped_at_black(spark, folder):
    return rg.stopped_at_black(ft(spark, folder), (C("across") >= 0) & (F.abs("along") <= 160), 0.05, H, W)


@query("pinned_to_line_g7", "framed", f"""WITH s AS (SELECT *, floor(along / 80) AS s FROM framed), d AS (SELECT image, s, max(across) AS d FROM s WHERE lab = 1 AND across >= 0 GROUP BY 1, 2),
{finish('z', 'SELECT s.image, y, x FROM s JOIN d ON d.image = s.image AND d.s = s.s WHERE tissue AND across >= 0 AND across <= d')} SELECT * FROM z""")
def pinned_to_line(spark, folder):
    return rg.pinned_to_line(ft(spark, folder), C("lab") == 1, 80.0, H, W)


GAPS = ERODE.replace("green < 0.12::DOUBLE", "NOT (green >= 0)")
FILL = f"""{GAPS}, cl AS (SELECT f.image, f.y, f.x, f.green, f.along, f.across, CAST(round_even((along + 160) / 16, 0) AS BIGINT) AS ray, CAST(round_even(across / 8, 0) AS BIGINT) AS step, o.f AS bar FROM framed f JOIN o ON o.image = f.image AND o.y = f.y AND o.x = f.x WHERE across >= 0 AND along BETWEEN -160 AND 160),
sz AS (SELECT image, max(ray) AS mr, max(step) + 1 AS width FROM cl GROUP BY image), w0 AS (SELECT sz.image, t.i AS ray, width, (SELECT min(step) FROM cl WHERE cl.image = sz.image AND cl.ray = t.i AND bar) AS s FROM sz, range(0, 40) t(i) WHERE t.i <= mr),
st AS (SELECT image, ray, width, coalesce(s, width) AS stop, s IS NOT NULL AS found FROM w0)"""


@query("fill_to_gap_g8", "framed", f"""WITH {FILL}, n AS (SELECT s.*, (SELECT max(ray) FROM st p WHERE p.image = s.image AND p.found AND p.ray <= s.ray) AS pr, (SELECT min(ray) FROM st p WHERE p.image = s.image AND p.found AND p.ray >= s.ray) AS nr FROM st s),
v AS (SELECT n.*, p.stop AS ps, q.stop AS qs FROM n LEFT JOIN st p ON p.image = n.image AND p.ray = n.pr LEFT JOIN st q ON q.image = n.image AND q.ray = n.nr),
b AS (SELECT image, ray, coalesce(CAST(round_even(CASE WHEN pr = nr THEN ps WHEN pr IS NULL THEN qs WHEN nr IS NULL THEN ps ELSE ps + (ray - pr) / CAST(nr - pr AS DOUBLE) * (qs - ps) END, 0) AS BIGINT), stop) AS stop FROM v),
md AS (SELECT a.image, a.ray, CAST(round_even(quantile_cont(o.stop, 0.5), 0) AS BIGINT) AS stop FROM b a JOIN b o ON o.image = a.image AND abs(o.ray - a.ray) <= 1 GROUP BY 1, 2),
fa AS (SELECT m.image, m.ray, CASE WHEN found THEN least(m.stop, st.stop) ELSE m.stop END AS stop FROM md m JOIN st ON st.image = m.image AND st.ray = m.ray),
cm AS (SELECT a.image, a.ray, min(o.stop + 4 * abs(o.ray - a.ray)) AS stop FROM fa a JOIN fa o ON o.image = a.image GROUP BY 1, 2)
SELECT cl.image, cl.y, cl.x FROM cl JOIN cm ON cm.image = cl.image AND cm.ray = cl.ray WHERE cl.step < cm.stop""")
def fill_to_gap(spark, folder):
    region, _ = rg.fill_between(ft(spark, folder), C("green") >= 0, -160.0, 160.0, 1, H, W, median=3, faithful=True, clamp=4)
    return region


PROFILE = "profile_g AS (SELECT p.image, p.bin, p.bin * 16.0::DOUBLE AS position, q.v AS value FROM (SELECT e.image, t.i AS bin FROM (SELECT image, min(bin) AS lo, max(bin) AS hi FROM pg GROUP BY image) e, range(-40, 40) t(i) WHERE t.i BETWEEN lo AND hi) p LEFT JOIN pg q ON q.image = p.image AND q.bin = p.bin)"


@query("end_window_g9", "framed", f"WITH {FILL}, rgn AS (SELECT cl.* FROM cl JOIN st ON st.image = cl.image AND st.ray = cl.ray WHERE cl.step < st.stop AND across <= 120), pg AS (SELECT image, CAST(round_even(along / 16, 0) AS BIGINT) AS bin, avg(green) AS v FROM rgn GROUP BY 1, 2), {PROFILE}, " +
       depth_sql("profile_g", 0).strip()[5:].replace("c AS (SELECT", "c AS (SELECT", 1) + _ends_sql("").replace("400", "96") + """
SELECT i.image, CASE WHEN coalesce(coalesce(low, le), -160) < coalesce(coalesce(high, he), 160) THEN coalesce(coalesce(low, le), -160) ELSE -160 END AS low, CASE WHEN coalesce(coalesce(low, le), -160) < coalesce(coalesce(high, he), 160) THEN coalesce(coalesce(high, he), 160) ELSE 160 END AS high
FROM (SELECT DISTINCT image FROM framed) i LEFT JOIN n ON n.image = i.image LEFT JOIN pr ON pr.image = i.image""")
def end_window(spark, folder):
    f = ft(spark, folder)
    region, _ = rg.fill_between(f, C("green") >= 0, -160.0, 160.0, 1, H, W, bridge=False)
    return rg.end_window(f, region, 10, 96.0, 160.0, 120.0)


@query("first_region_rule_g10")
def first_region_rule(spark, folder):
    return rg.first_region_rule(ft(spark, folder), H, W, 0.0, 1, 160.0)[0]


@query("second_region_rule_g11")
def second_region_rule(spark, folder):
    return rg.second_region_rule(ft(spark, folder), H, W, 0.0, 1, 160.0)[0]


TRAP = "across - 10 >= 0 AND across - 10 <= 90 AND along >= {s} - 120 + 0.2::DOUBLE * (across - 10) AND along <= {s} + 100 - 0.1::DOUBLE * (across - 10)"


def _constants(spark, folder):
    values = {"near": 10.0, "depth": 90.0, "low": -120.0, "high": 100.0, "slope_low": 0.2, "slope_high": -0.1}
    return bands(spark, folder).select("image", *[F.lit(v).alias(n) for n, v in values.items()])


@query("trapezoid_g12", "framed", "SELECT image, y, x FROM framed WHERE tissue AND " + TRAP.format(s="0"))
def trapezoid(spark, folder):
    return rg.trapezoid(ft(spark, folder), _constants(spark, folder), 1).select("image", "y", "x")


@query("shifted_trapezoid_g12", "framed", "WITH h AS (SELECT image, 40 - avg(along) AS s FROM framed WHERE " + TRAP.format(s="0") + " GROUP BY image) SELECT f.image, y, x FROM framed f LEFT JOIN h ON h.image = f.image WHERE tissue AND " + TRAP.format(s="coalesce(s, 0)"))
def shifted_trapezoid(spark, folder):
    f, k = ft(spark, folder), _constants(spark, folder)
    target = k.select("image", F.lit(40.0).alias("along"))
    return rg.trapezoid(f, rg.shifted_to(f, k, 1, target), 1).select("image", "y", "x")


@query("solid_offsets_g13", "framed", DIRECTIONS + """, folds AS (SELECT DISTINCT bird FROM e), s AS (SELECT folds.bird, k, CASE WHEN var_pop(reach - centre) > 1e-9 THEN least(greatest(regr_slope(o - centre, reach - centre), 0), 1.5::DOUBLE) ELSE 0 END AS slope, avg(o - centre) AS my, avg(reach - centre) AS mx FROM folds JOIN e ON e.bird <> folds.bird GROUP BY 1, 2),
q AS (SELECT e.image, e.k, e.centre, slope * (reach - centre) + my - slope * mx AS rad, o - centre AS net FROM e JOIN s ON s.bird = e.bird AND s.k = e.k)
SELECT image, k, round(centre + greatest(rad + least(greatest(net - rad, -50), 50), 60), 3) AS offset_um FROM q""")
def solid_offsets(spark, folder):
    f = ft(spark, folder)
    mine = fits.direction_extents(f, C("lab") == 1).select("image", "bird", F.posexplode(F.arrays_zip("offsets", "centre")).alias("k", "z")).select(
        "image", "bird", "k", C("z.offsets").alias("offset"), C("z.centre").alias("centre"))
    reach = fits.direction_extents(f, C("tissue")).select("image", "bird", F.posexplode("offsets").alias("k", "reach"))
    about = mine.join(reach.select("image", "k", "reach"), ["image", "k"]).select(
        "bird", "k", (C("reach") - C("centre")).alias("reach"), (C("offset") - C("centre")).alias("offset"))
    prior = fits.reach_prior(about, "bird")
    net = mine.select("image", "k", (C("offset") - C("centre")).alias("radius"))
    made = rg.solid_offsets(mine.select("image", "k", "centre"), reach, prior, net, 50.0, 60.0)
    return made.select("image", C("k").cast("long").alias("k"), r("offset", "offset_um", 3))


@query("median_offsets_g13", "framed", DIRECTIONS + """, folds AS (SELECT DISTINCT bird FROM e),
s AS (SELECT folds.bird, k, quantile_cont(o - centre, 0.5) AS med FROM folds JOIN e ON e.bird <> folds.bird WHERE o IS NOT NULL GROUP BY 1, 2)
SELECT e.image, e.k, round(centre + greatest(med, 60), 3) AS offset_um FROM e JOIN s ON s.bird = e.bird AND s.k = e.k WHERE e.o IS NOT NULL""")
def median_offsets(spark, folder):
    """The collapse-proof polygon from the median radius of the other birds, without a second mask."""
    f = ft(spark, folder)
    mine = fits.direction_extents(f, C("lab") == 1).select("image", "bird", F.posexplode(F.arrays_zip("offsets", "centre")).alias("k", "z")).select(
        "image", "bird", "k", C("z.offsets").alias("offset"), C("z.centre").alias("centre"))
    prior = fits.median_radii(mine.select("bird", "image", "k", (C("offset") - C("centre")).alias("radius")), "bird")
    reach = mine.select("image", "k", "bird", C("offset").alias("reach"))  # has no weight at slope 0
    none = mine.select("image", "k", F.lit(None).cast("double").alias("radius"))
    made = rg.solid_offsets(mine.select("image", "k", "centre"), reach, prior, none, 50.0, 60.0)
    return made.select("image", C("k").cast("long").alias("k"), r("offset", "offset_um", 3))


@query("work_set_g14", "framed cells", """
WITH f AS (SELECT image, count(*) AS pixels, count(*) FILTER (tissue) AS tissue_px, count(*) FILTER (lab > 0) AS labelled FROM framed GROUP BY image), c AS (SELECT k % (SELECT max(image) + 1 FROM framed) AS image, count(*) AS cells FROM cells GROUP BY 1)
SELECT f.image, pixels, tissue_px, labelled, coalesce(cells, 0) AS cells, CASE WHEN f.image % 3 = 2 THEN 'the band could not be placed' END AS reason FROM f LEFT JOIN c ON c.image = f.image""")
def work_set(spark, folder):
    cells = fx.cells_on_images(spark, folder).select("image")
    return rg.work_set(ft(spark, folder), bands(spark, folder).filter("image % 3 <> 2"), cells)


@query("cut_segment_g15", "outlines outline_edges", """
WITH c AS (SELECT section_id, avg(y) AS cy, avg(x) AS cx FROM outlines GROUP BY 1), v AS (SELECT e.*, (y1 - cy) * 0.4535961214255773::DOUBLE + (x1 - cx) * 0.8912073600614354::DOUBLE - 3.5::DOUBLE AS h, (y2 - cy) * 0.4535961214255773::DOUBLE + (x2 - cx) * 0.8912073600614354::DOUBLE - 3.5::DOUBLE AS t FROM outline_edges e JOIN c ON c.section_id = e.section_id),
p AS (SELECT section_id, y1 + h / nullif(h - t, 0) * (y2 - y1) AS py, x1 + h / nullif(h - t, 0) * (x2 - x1) AS px FROM v WHERE (h <= 0) <> (t <= 0))
SELECT section_id, round(arg_min(py, px * 0.4535961214255773::DOUBLE - py * 0.8912073600614354::DOUBLE), 4) AS y1, round(arg_min(px, px * 0.4535961214255773::DOUBLE - py * 0.8912073600614354::DOUBLE), 4) AS x1, round(arg_max(py, px * 0.4535961214255773::DOUBLE - py * 0.8912073600614354::DOUBLE), 4) AS y2, round(arg_max(px, px * 0.4535961214255773::DOUBLE - py * 0.8912073600614354::DOUBLE), 4) AS x2, count(*) AS crossings FROM p GROUP BY section_id HAVING count(*) >= 2""")
def cut_segment(spark, folder):
    ring = fx.outlines(spark, folder)
    axis = ring.groupBy("section_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx")).select(
        "section_id", "cy", "cx", F.lit(0.4535961214255773).alias("ay"), F.lit(0.8912073600614354).alias("ax"), F.lit(3.5).alias("midpoint"))
    return polygons.cut_segment(polygons.edges(ring, ["section_id"]), axis, "section_id").select("section_id", *[r(n, n, 4) for n in ("y1", "x1", "y2", "x2")], "crossings")


@query("border_coincidence_a36", "framed", f"""WITH {BOUND}, d AS (SELECT bd.image, bd.y, bd.x, sqrt(CAST(min((bd.y - o.y) * (bd.y - o.y) + (bd.x - o.x) * (bd.x - o.x)) AS DOUBLE)) * 8 AS d FROM bd JOIN framed o ON o.image = bd.image AND o.lab = 2 GROUP BY 1, 2, 3)
SELECT image, count(*) AS pixels, round(quantile_cont(d, 0.5), 4) AS median_um, round(avg(CASE WHEN d <= 100 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_100 FROM d GROUP BY image""")
def border_coincidence(spark, folder):
    from stratafold.operators import raster as ra

    f = ft(spark, folder)
    far = ra.edge_distance(f, C("lab") != 2).filter("d2 IS NOT NULL")  # an image without the other region has no distance
    edge = ra.boundary(f, C("lab") == 1, H, W).join(far, ["image", "y", "x"])
    um = F.sqrt("d2") * 8
    return edge.groupBy("image").agg(F.count("*").alias("pixels"), r(F.percentile(um, 0.5), "median_um", 4), r(F.avg((um <= 100).cast("int")), "within_100"))
