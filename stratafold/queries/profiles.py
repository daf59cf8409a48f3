"""Registered queries: stops read off one-dimensional profiles along a band."""

from functools import reduce

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.operators import profiles as pr
from stratafold.queries.aggregates import r
from stratafold.registry import query

C = F.col

def depth_sql(profile: str, centre: int) -> str:
    """Dips, sides and candidates of a profile CTE or view; ends inside a WITH list."""
    return DEPTH.replace("profile", profile).replace("32", str(centre))


DEPTH = """
WITH dd AS (SELECT a.*, (SELECT max(value) FROM profile b WHERE b.image = a.image AND b.bin BETWEEN a.bin - 10 AND a.bin - 1) AS l, (SELECT max(value) FROM profile b WHERE b.image = a.image AND b.bin BETWEEN a.bin + 1 AND a.bin + 10) AS h FROM profile a),
depth AS (SELECT image, bin, position, value, CASE WHEN l IS NOT NULL AND h IS NOT NULL AND least(l, h) > 0 THEN 1 - value / least(l, h) END AS depth FROM dd),
sides AS (SELECT d.*, s.side, abs(d.bin - 32) AS ord FROM depth d, (VALUES (-1), (1)) s(side) WHERE (s.side = -1 AND d.bin <= 32) OR (s.side = 1 AND d.bin >= 32)),
inside AS (SELECT * FROM sides a WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sides g WHERE g.image = a.image AND g.side = a.side AND g.value IS NULL AND g.ord < a.ord
   AND EXISTS (SELECT 1 FROM sides t WHERE t.image = a.image AND t.side = a.side AND t.value IS NOT NULL AND t.ord < g.ord))),
c AS (SELECT *, first_value(position) OVER (PARTITION BY image, side ORDER BY ord DESC) AS edge FROM inside)
"""


def _c(spark, folder, guard=None):
    return pr.candidates(fx.profile(spark, folder), 10, guard)


@query("dip_depth_w11", "profile", DEPTH + "SELECT image, bin, round(depth, 6) AS depth FROM depth")
def dip_depth(spark, folder):
    return pr.dip_depth(fx.profile(spark, folder), 10).select("image", "bin", r("depth", "depth"))


DEPART = """
WITH m AS (SELECT image, quantile_cont(value, 0.5) AS ref FROM profile WHERE abs(position) <= 160 GROUP BY image),
dep AS (SELECT p.image, p.bin, p.position, coalesce(abs(value / ref - 1), 1) AS d FROM profile p JOIN m ON m.image = p.image WHERE ref > 0)
"""


@query("departure_w12", "profile", DEPART + "SELECT image, bin, round(d, 6) AS departure FROM dep")
def departure(spark, folder):
    return pr.departure(fx.profile(spark, folder), 160.0).select("image", "bin", r("departure", "departure"))


JUMP = """
WITH s AS (SELECT p.*, v.side, abs(p.bin - 32) AS ord FROM profile p, (VALUES (-1), (1)) v(side) WHERE (v.side = -1 AND p.bin <= 32) OR (v.side = 1 AND p.bin >= 32)),
b AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY image, side ORDER BY ord ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS base FROM s),
j AS (SELECT *, abs(value / base - 1) AS j FROM b WHERE ord >= 8 AND base > 0 AND value IS NOT NULL), k AS (SELECT DISTINCT image, side FROM s)
"""


@query("jump_stop_w13", "profile", JUMP + "SELECT k.image, k.side, arg_max(position, (j, -ord)) AS stop FROM k LEFT JOIN j ON j.image = k.image AND j.side = k.side GROUP BY 1, 2")
def jump_stop(spark, folder):
    return pr.jump_stop(fx.profile(spark, folder), 8)


@query("first_jump_w13", "profile", JUMP + "SELECT k.image, k.side, arg_min(position, ord) AS stop FROM k LEFT JOIN j ON j.image = k.image AND j.side = k.side AND j.j > 0.04::DOUBLE GROUP BY 1, 2")
def first_jump(spark, folder):
    return pr.jump_stop(fx.profile(spark, folder), 8, 0.04)


@query("dim_stop_w14", "profile", """
WITH s AS (SELECT p.image, p.bin, p.position, coalesce(value, 0) AS v, x.side, abs(p.bin - 32) AS ord FROM profile p, (VALUES (-1), (1)) x(side) WHERE (x.side = -1 AND p.bin <= 32) OR (x.side = 1 AND p.bin >= 32)),
m AS (SELECT image, quantile_cont(coalesce(value, 0), 0.5) AS ref FROM profile WHERE bin BETWEEN 22 AND 42 GROUP BY image),
d AS (SELECT s.*, v <= 0.97::DOUBLE * ref AS dim FROM s JOIN m ON m.image = s.image), g AS (SELECT *, ord - row_number() OVER (PARTITION BY image, side, dim ORDER BY ord) AS g FROM d),
u AS (SELECT image, side, min(ord) AS o FROM g WHERE dim GROUP BY image, side, g HAVING count(*) >= 3), f AS (SELECT s.image, s.side, coalesce(min(u.o), max(s.ord)) AS o FROM s LEFT JOIN u ON u.image = s.image AND u.side = s.side GROUP BY 1, 2)
SELECT image, side, side * o * 16.0::DOUBLE AS stop FROM f""")
def dim_stop(spark, folder):
    return pr.dim_stop(fx.profile(spark, folder), 0.97, 10, 3)


@query("line_window_w14", "profile", """
WITH t AS (SELECT image, bin, position, value IS NOT NULL AND bin <> 10 + image % 3 AS solid FROM profile), g AS (SELECT *, bin - row_number() OVER (PARTITION BY image, solid ORDER BY bin) AS g FROM t),
n AS (SELECT image, arg_min(g, (abs(position), position)) AS g FROM g WHERE solid GROUP BY image), e AS (SELECT g.image, min(position) AS lo, max(position) AS hi FROM g JOIN n ON n.image = g.image AND n.g = g.g WHERE solid GROUP BY 1),
l AS (SELECT image, least(greatest(lo, -300 - 60), -300 + 100) AS low, least(greatest(hi, 300 - 100), 300 + 60) AS high FROM e) SELECT image, CASE WHEN low < high THEN low ELSE -300 END AS low, CASE WHEN low < high THEN high ELSE 300 END AS high FROM l""")
def line_window(spark, folder):
    run = pr.solid_run(fx.profile(spark, folder), C("value").isNotNull() & (C("bin") != 10 + C("image") % 3))
    return pr.leashed_window(run, 300.0, 100.0, 60.0)


@query("march_w14", "framed", """
WITH b AS (SELECT image, CAST(floor(along / 20) AS BIGINT) AS bin, avg(CASE WHEN green >= -0.15::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS t, avg(CASE WHEN green < -0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS k FROM framed WHERE abs(across) <= 40 GROUP BY 1, 2)
SELECT image, max(bin * 20.0::DOUBLE) FILTER (bin >= 0 AND (SELECT arg_min(t, bin) FROM b c WHERE c.image = b.image AND c.bin >= 0) >= 0.5::DOUBLE AND NOT EXISTS (SELECT 1 FROM b s WHERE s.image = b.image AND s.bin > 0 AND s.bin <= b.bin AND (s.t < 0.5::DOUBLE OR s.k >= 0.15::DOUBLE))) AS stop
FROM b WHERE bin >= 0 GROUP BY image""")
def march(spark, folder):
    strip = fx.framed(spark, folder).filter("abs(across) <= 40")
    b = strip.groupBy("image", F.floor(C("along") / 20).alias("bin")).agg(
        F.avg((C("green") >= -0.15).cast("int")).alias("tissue"), F.avg((C("green") < -0.2).cast("int")).alias("black")).withColumn("position", C("bin") * 20.0)
    return pr.march(b, 0.5, 0.15)


@query("dip_stop_w15", "profile", DEPTH + """
SELECT image, side, arg_max(position, (depth, -ord)) FILTER (depth IS NOT NULL) AS deepest, any_value(edge) AS edge, arg_max(position, (depth, -ord)) FILTER (depth IS NOT NULL AND abs(position) >= 100) AS past_floor,
  arg_max(position, (depth, -ord)) FILTER (depth IS NOT NULL AND abs(position) >= 0.5::DOUBLE * abs(edge)) AS past_share, coalesce(arg_max(position, (depth, -ord)) FILTER (depth >= 0.06::DOUBLE), any_value(edge)) AS deep_or_edge FROM c GROUP BY image, side""")
def dip_stop(spark, folder):
    c = _c(spark, folder)
    base = pr.dip_stop(c).withColumnRenamed("stop", "deepest")
    for name, options in (("past_floor", {"floor_um": 100.0}), ("past_share", {"floor_share": 0.5}), ("deep_or_edge", {"min_depth": 0.06, "else_edge": True})):
        base = base.join(pr.dip_stop(c, **options).select("image", "side", C("stop").alias(name)), ["image", "side"])
    return base


STEP = DEPART + """, s AS (SELECT d.*, v.side, abs(d.bin - 32) AS ord FROM dep d, (VALUES (-1), (1)) v(side) WHERE (v.side = -1 AND d.bin <= 32) OR (v.side = 1 AND d.bin >= 32)),
g AS (SELECT *, d > 0.03::DOUBLE AS f, ord - row_number() OVER (PARTITION BY image, side, d > 0.03::DOUBLE ORDER BY ord) AS g FROM s),
runs AS (SELECT image, side, f, min(ord) AS a, max(ord) AS z, sum(d) AS w FROM g GROUP BY image, side, f, g HAVING count(*) >= 3), k AS (SELECT DISTINCT image, side FROM s)
"""


@query("step_stop_w15", "profile", STEP + """
SELECT k.image, k.side, k.side * min(a) FILTER (f) * 16.0::DOUBLE AS first, k.side * arg_max(a, (round(w, 9), -a)) FILTER (f) * 16.0::DOUBLE AS strong, k.side * max(z) FILTER (NOT f) * 16.0::DOUBLE AS inward
FROM k LEFT JOIN runs ON runs.image = k.image AND runs.side = k.side GROUP BY k.image, k.side""")
def step_stop(spark, folder):
    p = fx.profile(spark, folder)
    parts = [pr.step_stop(p, 0.03, 160.0, 3, d).withColumnRenamed("stop", d) for d in ("first", "strong", "inward")]
    return reduce(lambda a, b: a.join(b, ["image", "side"]), parts)


@query("dip_candidates_w16", "profile", DEPTH + "SELECT image, side, bin, round(depth, 6) AS depth, edge, depth IS NOT NULL AND abs(position - edge) > 80 AS usable FROM c")
def dip_candidates(spark, folder):
    return _c(spark, folder, 80.0).select("image", C("side"), "bin", r("depth", "depth"), "edge", "usable")


def _ends_sql(floor: str) -> str:
    return f""", lo AS (SELECT * FROM c WHERE side = -1 AND depth IS NOT NULL {floor}), hi AS (SELECT * FROM c WHERE side = 1 AND depth IS NOT NULL {floor}),
ee AS (SELECT image, any_value(edge) FILTER (side = -1) AS le, any_value(edge) FILTER (side = 1) AS he FROM c GROUP BY image),
pr AS (SELECT lo.image, arg_max(lo.position, (round(lo.depth + hi.depth, 12), -lo.ord, -hi.ord)) AS low, arg_max(hi.position, (round(lo.depth + hi.depth, 12), -lo.ord, -hi.ord)) AS high FROM lo JOIN hi ON hi.image = lo.image AND hi.position - lo.position >= 400 GROUP BY lo.image),
n AS (SELECT ee.*, (SELECT count(*) FROM lo WHERE lo.image = ee.image) AS nl, (SELECT count(*) FROM hi WHERE hi.image = ee.image) AS nh,
  (SELECT arg_max(position, (depth, -ord)) FROM hi WHERE hi.image = ee.image AND position - le >= 400) AS oh, (SELECT arg_max(position, (depth, -ord)) FROM lo WHERE lo.image = ee.image AND he - position >= 400) AS ol FROM ee)"""


PAIRED = _ends_sql("AND depth >= 0.04") + """, ends AS (SELECT n.image, CASE WHEN nl = 0 AND nh > 0 THEN le WHEN nh = 0 AND nl > 0 THEN coalesce(ol, le) ELSE coalesce(low, le) END AS low,
  CASE WHEN nl = 0 AND nh > 0 THEN coalesce(oh, he) WHEN nh = 0 AND nl > 0 THEN he ELSE coalesce(high, he) END AS high FROM n LEFT JOIN pr ON pr.image = n.image)"""


@query("joint_ends_w17", "profile", DEPTH + _ends_sql("") + " SELECT n.image, coalesce(low, le) AS low, coalesce(high, he) AS high FROM n LEFT JOIN pr ON pr.image = n.image")
def joint_ends(spark, folder):
    return pr.pair_of_ends(_c(spark, folder), 400.0)


@query("convincing_ends_w17", "profile", DEPTH + PAIRED + " SELECT * FROM ends")
def convincing_ends(spark, folder):
    return pr.pair_of_ends(_c(spark, folder), 400.0, 0.04)


@query("outermost_ends_w17", "profile", DEPTH + PAIRED + """, b AS (SELECT image, side, max(depth) AS b FROM c WHERE depth IS NOT NULL GROUP BY 1, 2 HAVING max(depth) > 0),
o AS (SELECT c.image, min(position) FILTER (c.side = -1) AS low, max(position) FILTER (c.side = 1) AS high FROM c JOIN b ON b.image = c.image AND b.side = c.side WHERE depth >= 0.6::DOUBLE * b GROUP BY c.image)
SELECT ends.image, CASE WHEN o.high - o.low >= 400 THEN o.low ELSE ends.low END AS low, CASE WHEN o.high - o.low >= 400 THEN o.high ELSE ends.high END AS high FROM ends LEFT JOIN o ON o.image = ends.image""")
def outermost_ends(spark, folder):
    return pr.outermost_ends(_c(spark, folder), 400.0, 0.6, 0.04)


@query("extended_ends_w17", "profile", DEPTH + PAIRED + """, h AS (SELECT c.image, c.side, max(depth) AS d FROM c JOIN ends ON ends.image = c.image WHERE position = CASE WHEN side = -1 THEN low ELSE high END GROUP BY 1, 2 HAVING max(depth) > 0),
x AS (SELECT c.image, min(position) FILTER (c.side = -1 AND position < low) AS lo, max(position) FILTER (c.side = 1 AND position > high) AS hi FROM c JOIN ends ON ends.image = c.image JOIN h ON h.image = c.image AND h.side = c.side WHERE depth >= 0.5::DOUBLE * h.d GROUP BY c.image)
SELECT ends.image, coalesce(x.lo, low) AS low, coalesce(x.hi, high) AS high FROM ends LEFT JOIN x ON x.image = ends.image""")
def extended_ends(spark, folder):
    return pr.extended_ends(_c(spark, folder), 400.0, 0.5, 0.04)


@query("anchored_ends_w17", "profile", DEPTH + """, a AS (SELECT image, arg_max(position, (depth, -side, -ord)) FILTER (depth IS NOT NULL) AS at_, arg_max(side, (depth, -side, -ord)) FILTER (depth IS NOT NULL) AS side, any_value(edge) FILTER (side = -1) AS le, any_value(edge) FILTER (side = 1) AS he FROM c GROUP BY image)
SELECT image, CASE WHEN at_ IS NULL THEN le WHEN side = -1 THEN at_ ELSE greatest(at_ - 500, le) END AS low, CASE WHEN at_ IS NULL THEN he WHEN side = -1 THEN least(at_ + 500, he) ELSE at_ END AS high FROM a""")
def anchored_ends(spark, folder):
    return pr.anchored_ends(_c(spark, folder), 500.0)


FRACTIONS = (0.02, 0.03, 0.04, 0.06)


@query("plateau_w18", "profile", DEPART + """, s AS (SELECT d.*, v.side, abs(d.bin - 32) AS ord FROM dep d, (VALUES (-1), (1)) v(side) WHERE (v.side = -1 AND d.bin <= 32) OR (v.side = 1 AND d.bin >= 32)),
x AS (SELECT s.*, fr, d > fr AS f FROM s, (VALUES (0.02::DOUBLE), (0.03::DOUBLE), (0.04::DOUBLE), (0.06::DOUBLE)) q(fr)), g AS (SELECT *, ord - row_number() OVER (PARTITION BY image, side, fr, f ORDER BY ord) AS g FROM x),
u AS (SELECT image, side, fr, min(ord) AS a FROM g WHERE f GROUP BY image, side, fr, g HAVING count(*) >= 3),
l AS (SELECT x.image, x.fr, min(-u.a * 16.0::DOUBLE) FILTER (u.side = -1) AS dummy, max(-u.a * 16.0::DOUBLE) FILTER (u.side = -1) AS low, min(u.a * 16.0::DOUBLE) FILTER (u.side = 1) AS high FROM (SELECT DISTINCT image, fr FROM x) x LEFT JOIN u ON u.image = x.image AND u.fr = x.fr GROUP BY 1, 2),
w AS (SELECT a.image, a.fr, a.low, a.high, count(b.fr) AS agree FROM l a LEFT JOIN l b ON b.image = a.image AND b.fr <> a.fr AND coalesce(abs(a.low - b.low) <= 80, a.low IS NULL AND b.low IS NULL) AND coalesce(abs(a.high - b.high) <= 80, a.high IS NULL AND b.high IS NULL) GROUP BY 1, 2, 3, 4)
SELECT image, arg_max(fr, (agree, fr)) AS fraction, max(agree) AS agree, arg_max(coalesce(low, 1e9), (agree, fr)) AS low, arg_max(coalesce(high, 1e9), (agree, fr)) AS high FROM w GROUP BY image""")
def plateau(spark, folder):
    p = fx.profile(spark, folder)
    rungs = []
    for f in FRACTIONS:
        s = pr.step_stop(p, f, 160.0, 3)
        rungs.append(s.groupBy("image").agg(F.max(F.when(C("side") == -1, C("stop"))).alias("low"), F.max(F.when(C("side") == 1, C("stop"))).alias("high")).withColumn("fraction", F.lit(f)))
    best = pr.most_stable(reduce(lambda a, b: a.unionByName(b), rungs), 80.0)
    far = F.lit(1e9)
    return best.select("image", "fraction", C("agree").cast("long").alias("agree"), F.coalesce("low", far).alias("low"), F.coalesce("high", far).alias("high"))
