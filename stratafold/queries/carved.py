"""Registered queries: carving at black separations, and the band between two labelled regions."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.operators import carving
from stratafold.plans import bands
from stratafold.queries.aggregates import r
from stratafold.queries.raster import BOUND, H, W, pieces
from stratafold.registry import query

#: Two dark cues with the scale and the least of their strips' floor, and the region that is carved.
CUES = {"a": ("green < -0.1::DOUBLE", 0.15, 3), "b": ("(y + image) % 11 = 3 AND green < 0.1::DOUBLE", 0.4, 3)}
REGION = "y BETWEEN 5 AND 44 AND x BETWEEN 4 AND 59"
LEAST, KEEP = 5, 4
OFFS = "offs AS (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i) WHERE abs(a.i) + abs(b.i) <= 1)"


def _cue(s: str, dark: str, scale: float, least: float) -> str:
    near = "q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx"
    thin = f"SELECT d.image, d.y, d.x FROM d{s} d JOIN g{s} g ON g.image = d.image AND g.y = d.y AND g.x = d.x WHERE d.f AND NOT g.f"
    return (f"d{s} AS (SELECT image, y, x, {dark} AS f FROM pixels), e{s} AS (SELECT p.image, p.y, p.x, count(*) FILTER (q.f) = 5 AS f FROM d{s} p, offs LEFT JOIN d{s} q ON {near} GROUP BY 1, 2, 3), "
            f"o{s} AS (SELECT p.image, p.y, p.x, bool_or(q.f) AS f FROM e{s} p, offs JOIN e{s} q ON {near} GROUP BY 1, 2, 3), "
            f"g{s} AS (SELECT p.image, p.y, p.x, bool_or(q.f) AS f FROM o{s} p, offs JOIN o{s} q ON {near} GROUP BY 1, 2, 3), {pieces('c' + s, thin)}, "
            f"f{s} AS (SELECT image, greatest({scale}::DOUBLE * 100 * avg(CASE WHEN f THEN 1 ELSE 0 END), {least}) AS floor FROM d{s} GROUP BY image), "
            f"b{s} AS (SELECT c.image, component FROM c{s} c JOIN f{s} f ON f.image = c.image GROUP BY 1, 2 HAVING greatest(max(y) - min(y), max(x) - min(x)) + 1 >= any_value(floor)), "
            f"w{s} AS (SELECT image, y, x FROM o{s} WHERE f UNION SELECT c.image, c.y, c.x FROM c{s} c JOIN b{s} b ON b.image = c.image AND b.component = c.component)")


BARRIER = f"{OFFS}, {', '.join(_cue(s, *c) for s, c in CUES.items())}, bar AS (SELECT * FROM wa UNION SELECT * FROM wb)"
CUT = f"""reg AS (SELECT image, y, x FROM pixels WHERE {REGION}),
tch AS (SELECT DISTINCT b.image, b.y, b.x FROM bar b JOIN reg ON reg.image = b.image AND abs(reg.y - b.y) + abs(reg.x - b.x) <= 1), {pieces('k', 'SELECT * FROM tch')},
s AS (SELECT image, component, avg(y) AS ay, avg(x) AS ax, 0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)) AS t FROM k GROUP BY 1, 2 HAVING greatest(max(y) - min(y), max(x) - min(x)) + 1 >= {LEAST}),
l AS (SELECT *, -cos(t) AS ny, sin(t) AS nx, -cos(t) * (image % 5 + 22 - ay) + sin(t) * (32 - ax) AS off FROM s),
cut AS (SELECT image, y, x FROM reg p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.image = p.image AND NOT ((ny * (p.y - ay) + nx * (p.x - ax)) * sign(off) >= least(0, abs(off) - {KEEP}))))"""


def _parts(spark, folder):
    p = fx.pixels(spark, folder)
    for name, (dark, _, _) in CUES.items():
        p = p.withColumn(name, F.expr(dark.replace("::DOUBLE", "D")))
    barrier = carving.scaled_barrier(p, {name: (scale, least) for name, (_, scale, least) in CUES.items()}, 1, H, W)
    centre = p.select("image").distinct().withColumn("cy", (F.col("image") % 5 + 22).cast("double")).withColumn("cx", F.lit(32.0))
    return p, p.filter(REGION), barrier, centre


@query("two_cue_barrier_r10", "pixels", f"WITH {BARRIER} SELECT image, y, x FROM bar")
def two_cue_barrier(spark, folder):
    return _parts(spark, folder)[2]


@query("half_plane_cuts_r10", "pixels", f"WITH {BARRIER}, {CUT} SELECT image, y, x FROM cut")
def half_plane_cuts(spark, folder):
    _, region, barrier, centre = _parts(spark, folder)
    return carving.cut_by_planes(region, carving.half_planes(carving.touching(barrier, region), centre, LEAST, KEEP))


@query("carve_at_black_r10", "pixels", f"""WITH {BARRIER}, {CUT},
al AS (SELECT image, y, x FROM cut WHERE NOT EXISTS (SELECT 1 FROM bar WHERE bar.image = cut.image AND bar.y = cut.y AND bar.x = cut.x)), {pieces('z', 'SELECT * FROM al')},
n AS (SELECT image, arg_min(component, ((y - (image % 5 + 22)) * (y - (image % 5 + 22)) + (x - 32) * (x - 32), y, x)) AS component FROM z GROUP BY image),
kept AS (SELECT z.image, z.y, z.x FROM z JOIN n ON n.image = z.image AND n.component = z.component),
{pieces('h', 'SELECT p.image, p.y, p.x FROM pixels p JOIN n ON n.image = p.image WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.image = p.image AND kept.y = p.y AND kept.x = p.x)')},
hp AS (SELECT image, component FROM h GROUP BY 1, 2 HAVING min(y) > 0 AND max(y) < 49 AND min(x) > 0 AND max(x) < 63)
SELECT * FROM kept UNION ALL SELECT h.image, h.y, h.x FROM h JOIN hp ON hp.image = h.image AND hp.component = h.component
UNION ALL SELECT image, y, x FROM cut WHERE image NOT IN (SELECT image FROM n)""")
def carve_at_black(spark, folder):
    p, region, barrier, centre = _parts(spark, folder)
    return carving.carve(region, barrier, centre, p, H, W, LEAST, KEEP)


def _facing(name: str, own: int, other: int) -> str:
    edge = BOUND.replace("bd AS", f"{name}b AS").replace("b.lab = 1", f"b.lab = {own}").replace("a.lab = 1", f"a.lab = {own}")
    return (f"{edge}, {name}d AS (SELECT p.image, p.y, p.x, min((p.y - o.y) * (p.y - o.y) + (p.x - o.x) * (p.x - o.x)) AS d2 FROM {name}b p JOIN framed o ON o.image = p.image AND o.lab = {other} GROUP BY 1, 2, 3), "
            f"{name}c AS (SELECT image, quantile_cont(sqrt(CAST(d2 AS DOUBLE)), 0.35) AS cut FROM {name}d GROUP BY image), "
            f"{name} AS (SELECT d.image, d.y, d.x FROM {name}d d JOIN {name}c c ON c.image = d.image WHERE sqrt(CAST(d2 AS DOUBLE)) <= cut)")


def _fit(name: str, source: str) -> str:
    """The line of a point set from its normal equations: the greater root of the scatter's characteristic equation gives its direction."""
    return (f"{name}s AS (SELECT image, avg(y) AS cy, avg(x) AS cx, avg(CAST(y * y AS DOUBLE)) - avg(y) * avg(y) AS vy, avg(CAST(x * x AS DOUBLE)) - avg(x) * avg(x) AS vx, avg(CAST(y * x AS DOUBLE)) - avg(y) * avg(x) AS vyx FROM {source} GROUP BY image), "
            f"{name}g AS (SELECT *, (vy + vx) / 2 + sqrt(pow((vx - vy) / 2, 2) + vyx * vyx) AS root FROM {name}s), "
            f"{name}e AS (SELECT *, CASE WHEN abs(vyx) > 1e-9 THEN root - vx WHEN vy > vx THEN 1 ELSE 0 END AS ey, CASE WHEN abs(vyx) > 1e-9 THEN vyx WHEN vy > vx THEN 0 ELSE 1 END AS ex FROM {name}g), "
            f"{name}n AS (SELECT e.image, cy, cx, -ex / sqrt(ex * ex + ey * ey) AS ny, ey / sqrt(ex * ex + ey * ey) AS nx, ty, tx FROM {name}e e JOIN deep ON deep.image = e.image), "
            f"{name}f AS (SELECT image, cy, cx, ny * s AS ny, nx * s AS nx FROM (SELECT *, CASE WHEN ny * (ty - cy) + nx * (tx - cx) < 0 THEN -1 ELSE 1 END AS s FROM {name}n) q)")


DEEP = ("dist AS (SELECT a.image, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d2 FROM framed a JOIN framed b ON b.image = a.image AND b.lab <> 1 WHERE a.lab = 1 GROUP BY 1, 2, 3), "
        "deep AS (SELECT image, arg_max(y, (d2, -y, -x)) AS ty, arg_max(x, (d2, -y, -x)) AS tx FROM dist GROUP BY image)")
BOTH = f"{_facing('n1', 1, 2)}, {_facing('n2', 2, 1)}, {DEEP}, {_fit('p', 'n1')}, {_fit('q', 'n2')}"


def _band(spark, folder, tilt):
    return bands.band_width(bands.band_from_labels(fx.framed(spark, folder), H, W, tilt), 8.0)


@query("band_from_labels_a14", "framed", f"""WITH {BOTH}, {_fit('j', '(SELECT * FROM n1 UNION SELECT * FROM n2) u')}
SELECT j.image, round(j.ny, 5) AS normal_y, round(j.nx, 5) AS normal_x, round(j.ny * (p.cy - 25) + j.nx * (p.cx - 32), 4) AS ncm_offset, round(j.ny * (q.cy - 25) + j.nx * (q.cx - 32), 4) AS cmm_offset,
  round((j.ny * (p.cy - q.cy) + j.nx * (p.cx - q.cx)) * 8, 3) AS width_um FROM jf j JOIN pf p ON p.image = j.image JOIN qf q ON q.image = j.image""")
def band_from_labels(spark, folder):
    b = _band(spark, folder, False)
    return b.select("image", r("normal_y", "normal_y", 5), r("normal_x", "normal_x", 5), r("ncm_offset", "ncm_offset", 4), r("cmm_offset", "cmm_offset", 4), r("width_um", "width_um", 3))


@query("tilted_band_a14", "framed", f"""WITH {BOTH}
SELECT p.image, round(p.ny, 5) AS normal_y, round(p.nx, 5) AS normal_x, round(p.ny * (p.cy - 25) + p.nx * (p.cx - 32), 4) AS ncm_offset, round(q.ny * (q.cy - 25) + q.nx * (q.cx - 32), 4) AS cmm_offset,
  round(q.ny, 5) AS cmm_normal_y, round(q.nx, 5) AS cmm_normal_x FROM pf p JOIN qf q ON q.image = p.image""")
def tilted_band(spark, folder):
    b = _band(spark, folder, True)
    return b.select("image", *[r(n, n, 5) for n in ("normal_y", "normal_x", "cmm_normal_y", "cmm_normal_x")], r("ncm_offset", "ncm_offset", 4), r("cmm_offset", "cmm_offset", 4))
