"""Registered queries: measured and fitted straight-edged shapes of both regions."""

from functools import reduce

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.plans import fits, shapes
from stratafold.plans import regions as rg
from stratafold.queries.aggregates import DIRECTIONS, r
from stratafold.queries.raster import H, W, pieces
from stratafold.registry import query

C = F.col
SIDES = {1: 1, 2: -1}
THICK, BIN, SLAB, REACH = 80.0, 20.0, 60.0, 400.0
NUMBERS = ("gap", "depth", "low", "high", "slope_low", "slope_high")
FRACTIONS = ("f_low", "f_high", "f_depth")


def both(build):
    """The rows of both sides, told apart by ``side``."""
    return reduce(lambda a, b: a.unionByName(b), [build(side, sign).withColumn("side", F.lit(side)) for side, sign in SIDES.items()])


VIEW = """WITH v AS (SELECT *, 1 AS side, 1 AS sg, across AS i, lab = 1 AS r FROM framed UNION ALL SELECT *, 2, -1, -across, lab = 2 FROM framed),
ext AS (SELECT image, coalesce(max(across) FILTER (tissue) - min(across) FILTER (tissue), 1.0::DOUBLE) AS extent FROM framed GROUP BY image)"""
MEASURED = VIEW + """, e AS (SELECT image, side, any_value(sg) AS sg, any_value(bird) AS bird, min(i) AS a, max(i) AS z, min(along) AS lo, max(along) AS hi FROM v WHERE r GROUP BY 1, 2),
sd AS (SELECT v.image, v.side, floor((along - lo) / 20) AS b, min(i) AS o, any_value(hi - lo) AS w FROM v JOIN e ON e.image = v.image AND e.side = v.side WHERE r GROUP BY 1, 2, 3 HAVING count(*) >= 20),
md AS (SELECT image, side, quantile_cont(o, 0.5) AS mid FROM sd WHERE b * 20 < w GROUP BY 1, 2 HAVING count(*) >= 3),
ln AS (SELECT e.*, coalesce(mid, a) AS line, extent FROM e LEFT JOIN md ON md.image = e.image AND md.side = e.side JOIN ext ON ext.image = e.image),
sl AS (SELECT v.image, v.side, floor((i - a) / 20) * 20 + 10 + any_value(a - line) AS d, min(along) AS l, max(along) AS h, any_value(z - a) AS w, floor((i - a) / 20) * 20 AS f FROM v JOIN ln ON ln.image = v.image AND ln.side = v.side
  WHERE r GROUP BY v.image, v.side, floor((i - a) / 20) HAVING count(*) >= 20),
en AS (SELECT image, side, regr_intercept(l, d) AS low, regr_intercept(h, d) AS high, regr_slope(l, d) AS sl, regr_slope(h, d) AS sh FROM sl WHERE f < w GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT ln.image, ln.side, sg, bird, sg * line AS line, CASE WHEN sg < 0 THEN line - 80 ELSE line END AS gap, CASE WHEN sg < 0 THEN line / extent END AS share, z - line AS depth, low, high, sg * sl AS slope_low, sg * sh AS slope_high
  FROM ln JOIN en ON en.image = ln.image AND en.side = ln.side)"""


def span(lines: str) -> str:
    """CTEs with the tissue's span behind the lines ``(image, side, near)`` of a table."""
    return f""", p AS (SELECT v.image, v.side, along, sg * (across - near) AS past FROM v JOIN {lines} t ON t.image = v.image AND t.side = v.side WHERE tissue AND sg * (across - near) BETWEEN 0 AND 400),
sp AS (SELECT image, side, min(along) AS s_lo, max(along) AS s_hi FROM p WHERE past <= 60 GROUP BY 1, 2),
dp AS (SELECT p.image, p.side, max(past) AS deep FROM p JOIN sp ON sp.image = p.image AND sp.side = p.side WHERE abs(along - (s_lo + s_hi) / 2) <= (s_hi - s_lo) / 4 GROUP BY 1, 2)"""


FRACTION = MEASURED + ", ow AS (SELECT image, side, line AS near FROM m)" + span("ow") + """,
rel AS (SELECT m.*, (low - s_lo) / greatest(s_hi - s_lo, 1) AS f_low, (high - s_lo) / greatest(s_hi - s_lo, 1) AS f_high, depth / greatest(deep, 1) AS f_depth
  FROM m JOIN sp ON sp.image = m.image AND sp.side = m.side JOIN dp ON dp.image = m.image AND dp.side = m.side)"""


def measured(spark, folder, side, sign):
    return shapes.measures(fx.framed(spark, folder), C("lab") == side, sign, THICK, BIN)


def rounded(names) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


@query("side_measures_a22", "framed", MEASURED + f" SELECT image, side, {rounded(('line', 'share', *NUMBERS))} FROM m")
def side_measures(spark, folder):
    return both(lambda side, sign: measured(spark, folder, side, sign)).select("image", "side", *[r(n, n, 4) for n in ("line", "share", *NUMBERS)])


@query("relative_measures_a22", "framed", FRACTION + f" SELECT image, side, {rounded(FRACTIONS)} FROM rel")
def relative_measures(spark, folder):
    made = both(lambda side, sign: shapes.relative_measures(fx.framed(spark, folder), measured(spark, folder, side, sign), sign, SLAB, REACH))
    return made.select("image", "side", *[r(n, n, 4) for n in FRACTIONS])


@query("relative_fit_a22", "framed", FRACTION + ", folds AS (SELECT DISTINCT bird, side FROM rel) SELECT folds.bird, folds.side, " + ", ".join(
    f"round(quantile_cont({n}, 0.5), 4) AS {n}" for n in ("gap", "share", *FRACTIONS)) + " FROM folds JOIN rel ON rel.bird <> folds.bird AND rel.side = folds.side GROUP BY 1, 2")
def relative_fit(spark, folder):
    """Medians of the relative numbers over the other birds, for both regions."""
    birds = fx.bands(spark, folder).select("image", "bird")

    def fitted(side, sign):
        numbers = shapes.relative_measures(fx.framed(spark, folder), measured(spark, folder, side, sign), sign, SLAB, REACH)
        return fits.fold_medians(numbers.join(birds, "image"), "bird", "image", ["gap", "share", *FRACTIONS])

    return both(fitted).select("bird", "side", *[r(n, n, 4) for n in ("gap", "share", *FRACTIONS)])


VALUES = {"gap": 10.3, "f_low": 0.1, "f_high": 0.8, "f_depth": 0.6, "slope_low": 0.2, "slope_high": -0.1}
LINE = "ct AS (SELECT image, 1 AS side, 10.3::DOUBLE AS near FROM ext UNION ALL SELECT image, 2, CASE WHEN image % 3 = 0 THEN -10.3::DOUBLE - 80 ELSE -0.13::DOUBLE * extent END FROM ext)"
INSIDE = ("sg * (across - near) BETWEEN 0 AND {d} AND along >= {l} + 0.2::DOUBLE * (across - near) AND along <= {h} - 0.1::DOUBLE * (across - near)")


def lines(spark, folder, sign):
    """Constants with their line; every third image has no share, so the line behind the band goes by the gap."""
    rows = fx.bands(spark, folder).select("image", *[F.lit(v).alias(n) for n, v in VALUES.items()], F.when(C("image") % 3 != 0, 0.13).alias("share"))
    return shapes.near_line(fx.framed(spark, folder), rows, sign, THICK)


@query("relative_trapezoid_g12", "framed", VIEW + f", {LINE}" + span("ct") + " SELECT v.image, v.side, y, x FROM v JOIN ct ON ct.image = v.image AND ct.side = v.side JOIN sp ON sp.image = v.image AND sp.side = v.side "
       "JOIN dp ON dp.image = v.image AND dp.side = v.side WHERE tissue AND " + INSIDE.format(d="0.6::DOUBLE * deep", l="s_lo + 0.1::DOUBLE * (s_hi - s_lo)", h="s_lo + 0.8::DOUBLE * (s_hi - s_lo)"))
def relative_trapezoid(spark, folder):
    f = fx.framed(spark, folder)
    return both(lambda side, sign: rg.trapezoid(f, shapes.sized_by_tissue(f, lines(spark, folder, sign), sign, SLAB, REACH), sign)).select("image", "side", "y", "x")


MARCH = f""", {LINE}, st AS (SELECT v.image, v.side, floor(along / 20) AS b, count(*) AS n, avg(CASE WHEN green >= -0.12::DOUBLE THEN 1 ELSE 0 END) AS t, avg(CASE WHEN green < -0.1::DOUBLE THEN 1 ELSE 0 END) AS k
  FROM v JOIN ct ON ct.image = v.image AND ct.side = v.side WHERE abs(across - near) <= 40 GROUP BY 1, 2, 3),
ok AS (SELECT image, side FROM st GROUP BY 1, 2 HAVING sum(n) >= 200 AND max(t) FILTER (b = 0) >= 0.5),
ends AS (SELECT ok.image, ok.side, 20.0::DOUBLE * (min(g.b) - 1) AS stop FROM ok, range(1, 131) g(b) WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.image = ok.image AND st.side = ok.side AND st.b = g.b AND t >= 0.5 AND k < 0.2::DOUBLE) GROUP BY 1, 2)"""


def stops(spark, folder, sign):
    f = fx.framed(spark, folder).withColumn("tissue", C("green") >= -0.12)
    return shapes.marched_end(f, lines(spark, folder, sign), C("green") < -0.1, black=0.2)


@query("marched_end_g12", "framed", VIEW + MARCH + " SELECT image, side, stop FROM ends")
def marched_end(spark, folder):
    return both(lambda side, sign: stops(spark, folder, sign))


HIGH = "hg AS (SELECT b.image, coalesce((stop - CASE WHEN b.image % 4 <> 1 THEN 30.5::DOUBLE END + 100) / 2, 100) AS high FROM bands b LEFT JOIN ends ON ends.image = b.image AND side = 2)"


@query("high_end_trapezoid_g12", "framed", VIEW + MARCH + f", {HIGH} SELECT v.image, y, x FROM v JOIN ct ON ct.image = v.image AND ct.side = v.side JOIN hg ON hg.image = v.image WHERE v.side = 2 AND tissue AND " + INSIDE.format(d="90", l="-120", h="high"))
def high_end_trapezoid(spark, folder):
    """The region behind the band whose high end is pulled to where its line meets black; every fourth image has no fitted overshoot."""
    k = lines(spark, folder, -1).select("*", F.lit(90.0).alias("depth"), F.lit(-120.0).alias("low"), F.lit(100.0).alias("high"), F.when(C("image") % 4 != 1, 30.5).alias("high_offset"))
    return rg.trapezoid(fx.framed(spark, folder), shapes.with_marched_high(k, stops(spark, folder, -1)), -1).select("image", "y", "x")


GROWN = f""", {LINE}, al AS (SELECT image * 2 + side - 1 AS image, y, x, across, side FROM v WHERE r AND green >= -0.04::DOUBLE),
{pieces('c', 'SELECT image, y, x FROM al')}, hit AS (SELECT DISTINCT c.image, component FROM c JOIN al ON al.image = c.image AND al.y = c.y AND al.x = c.x JOIN ct ON ct.image = c.image // 2 AND ct.side = al.side WHERE abs(across - near) <= 20),
big AS (SELECT image, arg_max(component, (n, -component)) AS component FROM (SELECT image, component, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY image), kp AS (SELECT * FROM hit UNION ALL SELECT * FROM big WHERE image NOT IN (SELECT image FROM hit)),
gr AS (SELECT c.image, c.y, c.x FROM c JOIN kp ON kp.image = c.image AND kp.component = c.component),
{pieces('o', "SELECT image * 2 + side - 1 AS image, y, x FROM v WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.image = v.image * 2 + v.side - 1 AND gr.y = v.y AND gr.x = v.x)")},
ho AS (SELECT image, component FROM o GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63), un AS (SELECT * FROM gr UNION ALL SELECT o.image, o.y, o.x FROM o JOIN ho ON ho.image = o.image AND ho.component = o.component)
SELECT image // 2 AS image, CAST(1 + image % 2 AS INTEGER) AS side, y, x FROM un"""


@query("grown_from_line_g12", "framed", VIEW + GROWN)
def grown_from_line(spark, folder):
    f = fx.framed(spark, folder)
    return both(lambda side, sign: shapes.grown_from_line(f.filter(C("lab") == side), f, f.filter("green < -0.04"), lines(spark, folder, sign), H, W, 20.0))


SLID = DIRECTIONS + """, oo AS (SELECT e.image, k, centre + 0.7::DOUBLE * (o - centre) AS o FROM e WHERE o IS NOT NULL), hit AS (SELECT p.image, y, x, across FROM (SELECT image, y, x, across, k, dy * along + dx * across AS v FROM framed, d) p
  JOIN oo ON oo.image = p.image AND oo.k = p.k GROUP BY 1, 2, 3, 4 HAVING bool_and(v <= oo.o)), mv AS (SELECT image, least(greatest(10.3::DOUBLE - min(across), -50), 50) AS mv FROM hit GROUP BY image)
SELECT oo.image, oo.k, round(o + dx * coalesce(mv, 0), 3) AS offset_um FROM oo JOIN d ON d.k = oo.k LEFT JOIN mv ON mv.image = oo.image"""


@query("slid_onto_line_g12", "framed", SLID)
def slid_onto_line(spark, folder):
    f = fx.framed(spark, folder)
    mine = fits.direction_extents(f, C("lab") == 1).select("image", F.posexplode(F.arrays_zip("offsets", "centre")).alias("k", "z"))
    offsets = mine.select("image", "k", (C("z.centre") + 0.7 * (C("z.offsets") - C("z.centre"))).alias("offset"))
    return shapes.slid_onto_line(offsets, f, lines(spark, folder, 1), 1, 50.0).select("image", C("k").cast("long").alias("k"), r("offset", "offset_um", 3))


@query("cut_at_line_g12", "framed", VIEW + f", {LINE} SELECT v.image, v.side, y, x FROM v JOIN ct ON ct.image = v.image AND ct.side = v.side WHERE r AND sg * (across - near) >= 0")
def cut_at_line(spark, folder):
    f = fx.framed(spark, folder)
    return both(lambda side, sign: shapes.cut_at_line(f.filter(C("lab") == side), lines(spark, folder, sign), sign)).select("image", "side", "y", "x")
