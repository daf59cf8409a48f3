"""Registered queries: counts, areas, densities, moments, extents and fitted numbers."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.constants import REGION_NAMES
from stratafold.functions.scalars import area_mm2
from stratafold.operators import metrics, moments, polygons, tables
from stratafold.plans import atlas, fits
from stratafold.queries.joins import NUMBERS_SQL, NUMBERS_VIEWS, numbers
from stratafold.registry import query

C = F.col


def r(value, name, digits=6):
    return F.round(value, digits).alias(name)


@query("tally_a1", "cells", "SELECT stem, region, count(*) AS n, count(*) FILTER (source = 'hand') AS by_hand FROM cells GROUP BY 1, 2")
def tally(spark, folder):
    return fx.cells(spark, folder).groupBy("stem", "region").agg(F.count("*").alias("n"), F.count_if(C("source") == "hand").alias("by_hand"))


@query("status_counts_a1", NUMBERS_VIEWS, NUMBERS_SQL + "SELECT status, count(*) AS n FROM numbers WHERE region = 'CMM' GROUP BY 1")
def status_counts(spark, folder):
    return numbers(spark, folder).filter("region = 'CMM'").groupBy("status").agg(F.count("*").alias("n"))


@query("region_area_a2", "framed", """
SELECT image, lab, count(*) FILTER (tissue) AS tissue_px, round_even(count(*) FILTER (tissue) * pow(CASE WHEN image % 4 = 3 THEN NULL ELSE 8.0::DOUBLE END / 1000, 2), 4) AS area_mm2 FROM framed WHERE lab > 0 GROUP BY 1, 2""")
def region_area(spark, folder):
    a = fx.framed(spark, folder).filter("lab > 0").groupBy("image", "lab").agg(F.count_if("tissue").alias("tissue_px"))
    return a.withColumn("area_mm2", area_mm2(C("tissue_px"), F.when(C("image") % 4 != 3, 8.0)))


@query("density_by_region_a3", NUMBERS_VIEWS, NUMBERS_SQL + """
SELECT region, count(*) AS n, round(avg(density_per_mm2), 6) AS mean, round(stddev_samp(density_per_mm2), 6) AS sd FROM numbers WHERE density_per_mm2 IS NOT NULL AND NOT stale GROUP BY region""")
def density_by_region(spark, folder):
    return tables.by_region(numbers(spark, folder)).select("region", "n", r("mean", "mean"), r("sd", "sd"))


BIRD_SQL = NUMBERS_SQL + """, birds AS (
SELECT bird, region, count(*) AS sections, round_even(avg(density_per_mm2), 1) AS mean_cells_per_mm2, round_even(stddev_samp(density_per_mm2), 1) AS sd,
  round_even(avg(area_mm2), 4) AS mean_area_mm2 FROM numbers WHERE density_per_mm2 IS NOT NULL AND NOT stale GROUP BY bird, region)
"""


@query("density_by_bird_a4", NUMBERS_VIEWS, BIRD_SQL + "SELECT * FROM birds")
def density_by_bird(spark, folder):
    return tables.in_reading_order(tables.by_bird(numbers(spark, folder)), "bird")


@query("export_rows_a5", NUMBERS_VIEWS, NUMBERS_SQL + """
SELECT bird, stem AS section, region, cells, area_mm2 AS "area mm2", density_per_mm2 AS "cells per mm2", CASE WHEN stale THEN 'STALE -- recount' ELSE '' END AS stale
FROM numbers WHERE cells IS NOT NULL""")
def export_rows(spark, folder):
    return tables.for_export(numbers(spark, folder))


@query("export_summary_a6", NUMBERS_VIEWS, NUMBERS_SQL + """
SELECT count(*) AS rows, count(*) FILTER (stale) AS stale_rows, count(DISTINCT stem) AS sections, count(DISTINCT bird) AS birds FROM numbers WHERE cells IS NOT NULL""")
def export_summary(spark, folder):
    return tables.export_summary(tables.for_export(numbers(spark, folder)))


@query("bird_summary_a6", NUMBERS_VIEWS, BIRD_SQL + """
SELECT count(*) AS rows, count(DISTINCT bird) AS birds, max(sections) AS most_sections, (SELECT count(*) FROM numbers WHERE cells IS NOT NULL AND stale) AS dropped FROM birds""")
def bird_summary(spark, folder):
    n = numbers(spark, folder)
    return tables.bird_summary(n, tables.by_bird(n))


@query("density_pivot_a7", NUMBERS_VIEWS, NUMBERS_SQL + """
SELECT stem, avg(density_per_mm2) FILTER (region = 'dNCM') AS "dNCM", avg(density_per_mm2) FILTER (region = 'vNCM') AS "vNCM", avg(density_per_mm2) FILTER (region = 'CMM') AS "CMM" FROM numbers GROUP BY stem""")
def density_pivot(spark, folder):
    return numbers(spark, folder).groupBy("stem").pivot("region", list(REGION_NAMES)).agg(F.avg("density_per_mm2"))


@query("section_results_a8", "section_cells section_areas", """
WITH n AS (SELECT section_id, region, count(*) AS d, count(*) FILTER (probability >= 0.5::DOUBLE) AS c FROM section_cells WHERE source = 'model' GROUP BY 1, 2)
SELECT a.section_id, a.region, coalesce(d, 0) AS detected, coalesce(c, 0) AS classified, tissue_px, 0.5::DOUBLE AS threshold, area_mm2,
  round_even(coalesce(c, 0) / area_mm2, 1) AS density_per_mm2, round_even(coalesce(d, 0) / area_mm2, 1) AS detected_density_per_mm2
FROM section_areas a LEFT JOIN n ON n.section_id = a.section_id AND n.region = a.region""")
def section_results(spark, folder):
    return tables.section_results(fx.section_cells(spark, folder).filter("source = 'model'"), fx.section_areas(spark, folder), 0.5)


@query("polygon_area_a9", "edges", "SELECT region, abs(sum(y1 * x2 - x1 * y2)) / 2.0 AS area, count(*) AS vertices FROM edges GROUP BY region")
def polygon_area(spark, folder):
    return polygons.polygon_area(polygons.edges(fx.verts(spark, folder), ["region"]), ["region"])


@query("longest_edge_a10", "outline_edges", """
WITH e AS (SELECT *, sqrt(CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE)) AS len,
  row_number() OVER (PARTITION BY section_id ORDER BY sqrt(CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE)) DESC, vertex) AS rn, count(*) OVER (PARTITION BY section_id) AS n FROM outline_edges)
SELECT section_id, round(max((y2 - y1) / nullif(len, 0)) FILTER (rn = 1), 6) AS dir_y, round(max((x2 - x1) / nullif(len, 0)) FILTER (rn = 1), 6) AS dir_x, round(max(len) FILTER (rn = 1), 6) AS longest,
  round(max(len) FILTER (rn = 2), 6) AS runner_up, max(len) FILTER (rn = 1) >= 2 * max(len) FILTER (rn = 2) AS clear FROM e WHERE n >= 3 GROUP BY section_id""")
def longest_edge(spark, folder):
    e = polygons.longest_edge(polygons.edges(fx.outlines(spark, folder), ["section_id"]), ["section_id"])
    return e.select("section_id", r("dir_y", "dir_y"), r("dir_x", "dir_x"), r("longest", "longest"), r("runner_up", "runner_up"), "clear")


@query("line_fit_a11", "pixels", """
WITH m AS (SELECT image, avg(y) AS cy, avg(x) AS cx, 0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)) AS t FROM pixels WHERE green >= 0.1::DOUBLE GROUP BY image)
SELECT image, round(cy, 6) AS cy, round(cx, 6) AS cx, round(sin(t), 5) AS dy, round(cos(t), 5) AS dx FROM m""")
def line_fit(spark, folder):
    return moments.line_fit(fx.pixels(spark, folder).filter("green >= 0.1"), "image").select("image", r("cy", "cy"), r("cx", "cx"), r("dy", "dy", 5), r("dx", "dx", 5))


@query("weighted_axis_a12", "pixels", """
WITH p AS (SELECT image, y, x, pow(green - 0.05::DOUBLE, 3) AS w FROM pixels WHERE green > 0.05::DOUBLE),
s AS (SELECT image, sum(w) AS w, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * y * y) / sum(w) AS yy, sum(w * x * x) / sum(w) AS xx, sum(w * y * x) / sum(w) AS yx FROM p GROUP BY image)
SELECT image, round(degrees(0.5 * atan2(2 * (yx - my * mx), (xx - mx * mx) - (yy - my * my))), 4) AS degrees FROM s""")
def weighted_axis(spark, folder):
    p = fx.pixels(spark, folder).filter("green > 0.05")
    return moments.weighted_axis(p, F.pow(C("green") - 0.05, F.lit(3.0)), "image").select("image", r("degrees", "degrees", 4))


@query("trimmed_extent_a13", "framed", "SELECT image, round(quantile_cont(along, 0.005), 5) AS low, round(quantile_cont(along, 0.995), 5) AS high FROM framed WHERE lab = 1 GROUP BY image")
def trimmed_extent(spark, folder):
    return fx.framed(spark, folder).filter("lab = 1").groupBy("image").agg(moments.extent(C("along")).alias("e")).select(
        "image", r(C("e")[0], "low", 5), r(C("e")[1], "high", 5))


@query("box_from_mask_a14", "framed", """
WITH l AS (SELECT image, avg(y) AS cy, avg(x) AS cx, 0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)) AS t FROM framed WHERE lab = 1 GROUP BY image),
p AS (SELECT f.image, cy, cx, t, sin(t) * (y - cy) + cos(t) * (x - cx) AS a, sin(t) * (x - cx) - cos(t) * (y - cy) AS c FROM framed f JOIN l ON l.image = f.image WHERE lab = 1),
e AS (SELECT image, any_value(cy) AS cy, any_value(cx) AS cx, any_value(t) AS t, quantile_cont(a, 0.005) AS alo, quantile_cont(a, 0.995) AS ahi, quantile_cont(c, 0.005) AS clo, quantile_cont(c, 0.995) AS chi FROM p GROUP BY image)
SELECT image, round(cy + 0.5 * (alo + ahi) * sin(t) - 0.5 * (clo + chi) * cos(t), 4) AS centre_y, round(cx + 0.5 * (alo + ahi) * cos(t) + 0.5 * (clo + chi) * sin(t), 4) AS centre_x,
  round(0.5 * (ahi - alo), 4) AS half_along, round(0.5 * (chi - clo), 4) AS half_across, round(sin(2 * t), 4) AS sin2t, round(cos(2 * t), 4) AS cos2t FROM e""")
def box_from_mask(spark, folder):
    region = fx.framed(spark, folder).filter("lab = 1").select("image", "y", "x")
    box = moments.box_of(region, moments.line_fit(region, "image"))
    return box.select("image", *[r(n, n, 4) for n in ("centre_y", "centre_x", "half_along", "half_across", "sin2t", "cos2t")])


@query("split_axis_a15", "outlines outline_edges", """
WITH d AS (SELECT section_id, arg_max((y2 - y1) / sqrt(CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE)), (CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE), -vertex)) AS dy,
  arg_max((x2 - x1) / sqrt(CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE)), (CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE), -vertex)) AS dx FROM outline_edges GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT section_id, avg(y) AS cy, avg(x) AS cx FROM outlines GROUP BY 1),
a AS (SELECT d.section_id, cy, cx, CASE WHEN dy * (5 - cy) + dx * (7 - cx) < 0 THEN -dy ELSE dy END AS ay, CASE WHEN dy * (5 - cy) + dx * (7 - cx) < 0 THEN -dx ELSE dx END AS ax FROM d JOIN c ON c.section_id = d.section_id)
SELECT a.section_id, round(any_value(cy), 6) AS cy, round(any_value(cx), 6) AS cx, round(any_value(ay), 6) AS ay, round(any_value(ax), 6) AS ax,
  round((min((y - cy) * ay + (x - cx) * ax) + max((y - cy) * ay + (x - cx) * ax)) / 2, 5) AS midpoint FROM a JOIN outlines o ON o.section_id = a.section_id GROUP BY a.section_id""")
def split_axis(spark, folder):
    ring = fx.outlines(spark, folder)
    direction = polygons.longest_edge(polygons.edges(ring, ["section_id"]), ["section_id"])
    marker = ring.select("section_id").distinct().withColumn("y", F.lit(5)).withColumn("x", F.lit(7))
    a = polygons.halving_axis(ring, direction, marker, "section_id")
    return a.select("section_id", r("cy", "cy"), r("cx", "cx"), r("ay", "ay"), r("ax", "ax"), r("midpoint", "midpoint", 5))


@query("mask_overlap_a16", "framed", """
WITH f AS (SELECT image, lab = 1 AS t, tissue AND across > 0 AS p FROM framed), n AS (SELECT image, count(*) FILTER (p AND t) AS b, count(*) FILTER (p OR t) AS e, count(*) FILTER (p) AS p, count(*) FILTER (t) AS t FROM f GROUP BY image)
SELECT image, round(b / greatest(e, 1), 6) AS iou, round(b / greatest(p, 1), 6) AS precision, round(b / greatest(t, 1), 6) AS recall, round(p / t - 1, 6) AS area_error FROM n""")
def mask_overlap(spark, folder):
    o = metrics.overlap(fx.framed(spark, folder), C("tissue") & (C("across") > 0), C("lab") == 1, "image")
    return o.select("image", *[r(n, n) for n in ("iou", "precision", "recall", "area_error")])


CELLS_ON_CANVAS = """
WITH c AS (SELECT k % (SELECT max(image) + 1 FROM framed) AS image, y * 50 // 480 AS y, x * 64 // 480 AS x FROM cells), j AS (SELECT f.* FROM c JOIN framed f ON f.image = c.image AND f.y = c.y AND f.x = c.x)
"""


def _cells_on_canvas(spark, folder):
    """Cells with the pixel they fall on; cells are counted per pixel before the join, so the pixel table meets distinct pixels."""
    c = fx.cells_on_images(spark, folder).select("image", F.floor(C("y") * 50 / 480).alias("y"), F.floor(C("x") * 64 / 480).alias("x"))
    return c.groupBy("image", "y", "x").agg(F.count("*").alias("n")).join(fx.framed(spark, folder), ["image", "y", "x"])


@query("cells_kept_a17", "cells framed", CELLS_ON_CANVAS + """
SELECT image, count(*) FILTER (lab = 1) AS cells, u.rung, count(*) FILTER (lab = 1 AND u.inside) AS kept, count(*) FILTER (u.inside AND lab = 2) AS other,
  count(*) FILTER (u.inside AND lab = 0) AS unlabelled, count(*) FILTER (u.inside) AS claimed
FROM (SELECT j.*, UNNEST([{'rung': 'line', 'inside': across > -100}, {'rung': 'cut', 'inside': across > -100 AND along < 100}]) AS u FROM j) GROUP BY image, u.rung HAVING count(*) FILTER (lab = 1) > 0""")
def cells_kept(spark, folder):
    rungs = {"line": C("across") > -100, "cut": (C("across") > -100) & (C("along") < 100)}
    return metrics.cell_shares(_cells_on_canvas(spark, folder), C("lab") == 1, C("lab") == 2, rungs, "image")


@query("pooled_cells_a17", "cells framed", CELLS_ON_CANVAS + """, s AS (
SELECT image, count(*) FILTER (lab = 1) AS cells, count(*) FILTER (lab = 1 AND across > -100) AS kept, count(*) FILTER (across > -100) AS claimed FROM j GROUP BY image HAVING count(*) FILTER (lab = 1) > 0)
SELECT 'line' AS rung, CAST(sum(cells) AS BIGINT) AS cells, round(sum(kept) / sum(cells), 6) AS recall, round(avg((claimed - kept) / greatest(claimed, 1)), 6) AS wrong_share FROM s""")
def pooled_cells(spark, folder):
    rows = metrics.cell_shares(_cells_on_canvas(spark, folder), C("lab") == 1, C("lab") == 2, {"line": C("across") > -100}, "image")
    return metrics.pooled(rows, "rung").select("rung", "cells", r("recall", "recall"), r("wrong_share", "wrong_share"))


@query("density_proxy_a18", "cells framed", CELLS_ON_CANVAS + """, a AS (SELECT image, count(*) FILTER (tissue AND across > 0) AS area, count(*) FILTER (lab = 1) AS drawn FROM framed GROUP BY image),
n AS (SELECT image, count(*) FILTER (lab = 1) AS cells, count(*) FILTER (lab = 1 AND tissue AND across > 0) AS kept FROM j GROUP BY image)
SELECT a.image, round(coalesce(kept, 0) / greatest(coalesce(cells, 0), 1), 6) AS share, round(area / greatest(drawn, 1), 6) AS area_ratio,
  round((coalesce(kept, 0) / greatest(coalesce(cells, 0), 1)) / greatest(area / greatest(drawn, 1), 1e-9::DOUBLE), 6) AS density FROM a LEFT JOIN n ON n.image = a.image""")
def density_proxy(spark, folder):
    found = C("tissue") & (C("across") > 0)
    areas = fx.framed(spark, folder).groupBy("image").agg(F.count_if(found).alias("area"), F.count_if(C("lab") == 1).alias("drawn"))
    n = _cells_on_canvas(spark, folder).groupBy("image").agg(
        metrics.weighted_count(C("lab") == 1, C("n")).alias("cells"), metrics.weighted_count((C("lab") == 1) & found, C("n")).alias("kept"))
    j = areas.join(n, "image", "left").fillna(0, ["cells", "kept"])
    return j.select("image", *metrics.density_proxy(C("kept"), C("cells"), C("area"), C("drawn"))).select("image", r("share", "share"), r("area_ratio", "area_ratio"), r("density", "density"))


ATLAS = """
WITH f AS (SELECT *, least(greatest(CAST(floor((along + 3000) / 50) AS BIGINT), 0), 119) * 140 + least(greatest(CAST(floor((across + 4000) / 50) AS BIGINT), 0), 139) AS bin FROM framed WHERE tissue)
"""


@query("atlas_votes_a19", "framed", ATLAS + """, o AS (SELECT image, bin, count(*) FILTER (lab = 1) AS hits, count(*) AS n FROM f GROUP BY 1, 2), t AS (SELECT bin, sum(hits) AS h, sum(n) AS n FROM o GROUP BY 1)
SELECT o.image, o.bin, round(coalesce((t.h - o.hits) / nullif(t.n - o.n, 0), 0), 6) AS share, CAST(t.n - o.n AS BIGINT) AS voters FROM o JOIN t ON t.bin = o.bin""")
def atlas_votes(spark, folder):
    b = atlas.with_bins(fx.framed(spark, folder).filter("tissue"), 50.0)
    return atlas.votes_without_own(b, C("lab") == 1, "image").select("image", "bin", r("share", "share"), "voters")


@query("atlas_held_out_a20", "framed", ATLAS + """, folds AS (SELECT DISTINCT image AS held FROM f), v AS (SELECT held, bin, avg(CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n FROM f JOIN folds ON f.image <> held GROUP BY 1, 2)
SELECT f.image, count(*) FILTER (lab = 1) AS drawn, count(*) FILTER (v.share >= 0.5::DOUBLE AND v.n >= 10) AS found, count(*) FILTER (v.share >= 0.5::DOUBLE AND v.n >= 10 AND lab = 1) AS both
FROM f LEFT JOIN v ON v.held = f.image AND v.bin = f.bin GROUP BY f.image""")
def atlas_held_out(spark, folder):
    b = atlas.with_bins(fx.framed(spark, folder).filter("tissue"), 50.0)
    return atlas.leave_one_out(b, C("lab") == 1, "image", 0.5, 10)


@query("atlas_footprint_a20", "framed", ATLAS + """, v AS (SELECT bin, avg(CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n FROM f GROUP BY 1),
k AS (SELECT bin // 140 * 50.0::DOUBLE - 3000 AS a, bin % 140 * 50.0::DOUBLE - 4000 AS c FROM v WHERE share >= 0.5::DOUBLE AND n >= 10)
SELECT count(*) AS bins, count(*) * 0.0025::DOUBLE AS area_mm2, min(c) AS across_low, max(c) + 50 AS across_high, min(a) AS along_low, max(a) + 50 AS along_high FROM k""")
def atlas_footprint(spark, folder):
    b = atlas.with_bins(fx.framed(spark, folder).filter("tissue"), 50.0)
    return atlas.footprint(atlas.votes(b, C("lab") == 1), 0.5, 10, 50.0)


MEASURED = """
WITH near AS (SELECT image, any_value(bird) AS bird, min(across) AS near, max(across) - min(across) AS depth FROM framed WHERE lab = 1 GROUP BY image),
sl AS (SELECT f.image, floor((across - near) / 20) AS s, count(*) AS n, min(along) AS lo, max(along) AS hi FROM framed f JOIN near ON near.image = f.image WHERE lab = 1 GROUP BY 1, 2 HAVING count(*) >= 20),
ends AS (SELECT image, regr_slope(lo, s * 20 + 10) AS slope_low, regr_intercept(lo, s * 20 + 10) AS low, regr_slope(hi, s * 20 + 10) AS slope_high, regr_intercept(hi, s * 20 + 10) AS high FROM sl GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT n.image, n.bird, near, depth, slope_low, low, slope_high, high FROM near n JOIN ends e ON e.image = n.image)
"""
NUMBERS = ("near", "depth", "slope_low", "low", "slope_high", "high")


def _measured(spark, folder):
    f = fx.framed(spark, folder)
    birds = fx.bands(spark, folder).select("image", "bird")
    return fits.measure(f, C("lab") == 1, 20.0).join(birds, "image")


@query("region_measures_a22", "framed", MEASURED + "SELECT image, " + ", ".join(f"round({n}, 4) AS {n}" for n in NUMBERS) + " FROM m")
def region_measures(spark, folder):
    return _measured(spark, folder).select("image", *[r(n, n, 4) for n in NUMBERS])


@query("fitted_constants_s29", "framed", MEASURED + "SELECT " + ", ".join(f"round(quantile_cont({n}, 0.5), 4) AS {n}" for n in NUMBERS) + " FROM m")
def fitted_constants(spark, folder):
    """One row of constants over all birds, stored in the shared folder and read back as later jobs do."""
    from stratafold.session import shared_path
    from stratafold.sources.sinks import write_whole

    path = shared_path(spark, "constants")
    write_whole(fits.fitted_constants(_measured(spark, folder), list(NUMBERS)), path)
    return spark.read.parquet(path).select(*[r(n, n, 4) for n in NUMBERS])


@query("fold_medians_a22", "framed", MEASURED + ", folds AS (SELECT DISTINCT bird FROM m) SELECT folds.bird, " + ", ".join(
    f"round(quantile_cont({n}, 0.5), 4) AS {n}" for n in NUMBERS) + " FROM folds JOIN m ON m.bird <> folds.bird GROUP BY folds.bird")
def fold_medians(spark, folder):
    return fits.fold_medians(_measured(spark, folder), "bird", "image", list(NUMBERS)).select("bird", *[r(n, n, 4) for n in NUMBERS])


DIRECTIONS = """
WITH d AS (SELECT k, cos(2 * pi() * k / 16) AS dy, sin(2 * pi() * k / 16) AS dx FROM range(0, 16) t(k)),
p AS (SELECT image, bird, k, dy * along + dx * across AS v, lab, tissue FROM framed, d),
e AS (SELECT image, bird, k, max(v) FILTER (lab = 1) AS o, max(v) FILTER (tissue) AS reach, avg(v) FILTER (lab = 1) AS centre FROM p GROUP BY 1, 2, 3)
"""


def _directions(spark, folder):
    f = fx.framed(spark, folder)
    mine = fits.direction_extents(f, C("lab") == 1)
    tissue = fits.direction_extents(f, C("tissue")).select("image", C("offsets").alias("reach"))
    j = mine.join(tissue, "image")
    return j.select("image", "bird", F.posexplode(F.arrays_zip("offsets", "reach", "centre")).alias("k", "z")).select(
        "image", "bird", "k", C("z.offsets").alias("offset"), C("z.reach").alias("reach"), C("z.centre").alias("centre"))


@query("direction_extents_a24", "framed", DIRECTIONS + "SELECT image, k, round(o, 4) AS reach_of_mask, round(reach, 4) AS reach, round(o - centre, 4) AS radius FROM e")
def direction_extents(spark, folder):
    return _directions(spark, folder).select("image", C("k").cast("long").alias("k"), r("offset", "reach_of_mask", 4), r("reach", "reach", 4), r(C("offset") - C("centre"), "radius", 4))


@query("reach_prior_a23", "framed", DIRECTIONS + """, folds AS (SELECT DISTINCT bird FROM e),
s AS (SELECT folds.bird, k, CASE WHEN var_pop(reach) > 1e-9 THEN least(greatest(regr_slope(o, reach), 0), 1.5::DOUBLE) ELSE 0 END AS slope, avg(o) AS my, avg(reach) AS mx FROM folds JOIN e ON e.bird <> folds.bird GROUP BY 1, 2)
SELECT bird, k, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM s""")
def reach_prior(spark, folder):
    return fits.reach_prior(_directions(spark, folder), "bird").select("bird", C("k").cast("long").alias("k"), r("slope", "slope", 4), r("intercept", "intercept", 3))


@query("dark_share_a25", "pixels", "SELECT image, round(100.0 * count(*) FILTER (green < 0.02::DOUBLE AND green >= -0.1::DOUBLE) / greatest(count(*) FILTER (green >= -0.1::DOUBLE), 1), 6) AS dark_percent FROM pixels GROUP BY image")
def dark_share(spark, folder):
    from stratafold.operators.raster import dark_percent

    return dark_percent(fx.pixels(spark, folder), C("green") < 0.02, C("green") >= -0.1, "image").withColumn("dark_percent", F.round("dark_percent", 6))


@query("section_measures_a29", "framed bands", """
WITH e AS (SELECT image, max(across) - min(across) AS depth, min(along) FILTER (across BETWEEN 0 AND 50) AS low, max(along) FILTER (across BETWEEN 0 AND 50) AS high,
  quantile_cont(across, 0.9) - quantile_cont(across, 0.1) AS spread FROM framed WHERE tissue GROUP BY image),
w AS (SELECT image, floor(along / 40) AS s, min(across) AS edge FROM framed WHERE lab = 1 GROUP BY 1, 2)
SELECT e.image, round(depth, 4) AS tissue_depth, round(low, 4) AS span_low, round(high, 4) AS span_high, round(spread, 4) AS spread, round((b.ncm_offset - b.cmm_offset) * 8, 4) AS band_um,
  round((b.span_high - b.span_low) / 2 * 8, 4) AS half_um, round((SELECT stddev_pop(edge) FROM w WHERE w.image = e.image), 4) AS wobble FROM e JOIN bands b ON b.image = e.image""")
def section_measures(spark, folder):
    f, b = fx.framed(spark, folder), fx.bands(spark, folder)
    return moments.section_measures(f, b, C("lab") == 1, 50.0, 40.0).select("image", *[r(n, n, 4) for n in (
        "tissue_depth", "span_low", "span_high", "spread", "band_um", "half_um", "wobble")])


@query("band_cap_a29", "framed", """
WITH b AS (SELECT image, CAST(floor(-across / 20) AS BIGINT) AS bin, count(*) AS n, avg(CASE WHEN green < -0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS dark FROM framed WHERE across < -40 AND across > -160 GROUP BY 1, 2)
SELECT i.image, coalesce(min(bin * 20.0::DOUBLE) FILTER (n >= 30 AND dark >= 0.15::DOUBLE), 160) AS width_um FROM (SELECT DISTINCT image FROM framed) i LEFT JOIN b ON b.image = i.image GROUP BY i.image""")
def band_cap(spark, folder):
    return moments.capped_width(fx.framed(spark, folder), C("green") < -0.1, 40.0, 160.0, 20.0, 30, 0.15)


@query("side_middle_a29", "framed", """
WITH s AS (SELECT image, min(along) AS start FROM framed WHERE lab = 1 GROUP BY image),
b AS (SELECT f.image, floor((along - start) / 40) AS b, min(across) AS edge FROM framed f JOIN s ON s.image = f.image WHERE lab = 1 GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT image, round(quantile_cont(edge, 0.5), 4) AS middle FROM b GROUP BY image HAVING count(*) >= 3""")
def side_middle(spark, folder):
    return fits.side_middle(fx.framed(spark, folder), C("lab") == 1, 40.0).select("image", r("middle", "middle", 4))


@query("class_weights_a30", "framed", """
WITH n AS (SELECT k AS class, greatest((SELECT count(*) FROM framed WHERE lab = k), 1) AS n FROM range(0, 4) t(k)) SELECT class, n, round(least(sum(n) OVER () / (4 * n), 20), 6) AS weight FROM n""")
def class_weights(spark, folder):
    return metrics.class_weights(fx.framed(spark, folder), "lab", 4).select(C("class").cast("long").alias("class"), "n", r("weight", "weight"))


@query("folder_report_a37", "files", """
WITH img AS (SELECT regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files
  WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('tif', 'tiff') AND NOT regexp_matches(path, '/\\.[^/]*/') AND NOT regexp_matches(path, '/(old|archive|runs)/'))
SELECT count(DISTINCT stem) AS images, count(*) - count(DISTINCT stem) AS duplicates, count(DISTINCT folder) AS folders FROM img""")
def folder_report(spark, folder):
    from stratafold.sources import catalog

    return catalog.folder_report(fx.files(spark, folder))


@query("printed_block_a39", NUMBERS_VIEWS, NUMBERS_SQL + """
SELECT stem, region, concat_ws('  ', region, coalesce(CAST(cells AS VARCHAR), '-'), coalesce(CAST(density_per_mm2 AS VARCHAR), '-')) AS line,
  CASE WHEN stale THEN 'recount: outlines are newer than the count' WHEN status <> 'counted' THEN status ELSE '' END AS note, area_mm2 IS NULL AS missing_area FROM numbers""")
def printed_block(spark, folder):
    n = numbers(spark, folder)
    dash = F.lit("-")
    return n.select("stem", "region", F.concat_ws("  ", "region", F.coalesce(C("cells").cast("string"), dash), F.coalesce(C("density_per_mm2").cast("string"), dash)).alias("line"),
                    tables.note(C("status"), C("stale")).alias("note"), C("area_mm2").isNull().alias("missing_area"))
