"""Registered queries: projections, predicates and scalar expressions."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.constants import ALREADY_QUEUED, ALREADY_RUNNING, COUNTING_OUTSIDE, NO_DORSAL, NO_REGIONS
from stratafold.functions import scalars as sc
from stratafold.operators import frames, matching
from stratafold.registry import query

C = F.col
STATUS = """CASE WHEN NOT has_regions THEN 'needs regions' WHEN NOT has_dorsal THEN 'needs dorsal marker'
WHEN NOT has_counts THEN 'ready to count' ELSE 'counted' END"""


@query("status_word_p1", "sections", f"SELECT section_id, {STATUS} AS status FROM sections")
def status_word(spark, folder):
    return fx.sections(spark, folder).select("section_id", sc.status(C("has_regions"), C("has_dorsal"), C("has_counts")).alias("status"))


@query("reason_to_skip_p2", "sections", f"""
SELECT section_id, CASE WHEN NOT has_regions THEN '{NO_REGIONS}' WHEN NOT has_dorsal THEN '{NO_DORSAL}' WHEN section_id % 97 = 0 THEN '{ALREADY_RUNNING}'
WHEN section_id % 5 = 0 THEN '{ALREADY_QUEUED}' WHEN owner % 4 = 0 THEN '{COUNTING_OUTSIDE}' END AS reason FROM sections""")
def reason_to_skip(spark, folder):
    return fx.sections(spark, folder).select("section_id", F.coalesce(
        sc.reason_to_skip(C("has_regions"), C("has_dorsal")),
        sc.first_reason((C("section_id") % 97 == 0, ALREADY_RUNNING), (C("section_id") % 5 == 0, ALREADY_QUEUED), (C("owner") % 4 == 0, COUNTING_OUTSIDE))).alias("reason"))


@query("batch_estimate_p3", "", """
WITH n AS (SELECT l_orderkey, count(*) - 1 AS n FROM lineitem GROUP BY 1), h AS (SELECT *, n * 35 AS lo, n * 45 AS hi,
  CAST(round_even(n * 35 / 60.0::DOUBLE, 0) AS BIGINT) AS lh, CAST(round_even(n * 45 / 60.0::DOUBLE, 0) AS BIGINT) AS hh FROM n)
SELECT l_orderkey, n, CASE WHEN n <= 0 THEN 'no time at all' WHEN hi <= 90 THEN concat('about ', lo, '-', hi, ' minutes')
  WHEN lh = hh THEN concat('about ', lh, ' hours') ELSE concat('about ', lh, '-', hh, ' hours') END AS estimate FROM h""")
def batch_estimate(spark, folder):
    n = fx.table(spark, folder, "lineitem").groupBy("l_orderkey").agg((F.count("*") - 1).alias("n"))
    return n.withColumn("estimate", sc.estimate(C("n")))


@query("elapsed_time_p4", "", """
WITH s AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS seconds FROM events)
SELECT event_id, seconds, concat(CASE WHEN seconds >= 86400 THEN concat(seconds // 86400, '-', lpad(CAST(seconds % 86400 // 3600 AS VARCHAR), 2, '0'), ':')
  WHEN seconds >= 3600 THEN concat(seconds // 3600, ':') ELSE '' END, lpad(CAST(seconds % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(seconds % 60 AS VARCHAR), 2, '0')) AS text,
  CASE WHEN event_id % 10 = 0 THEN -1 ELSE seconds // 60 END AS minutes FROM s""")
def elapsed_time(spark, folder):
    s = fx.table(spark, folder, "events").select("event_id", F.floor(C("value") * 1000).alias("seconds")).withColumn("text", sc.elapsed_text(C("seconds")))
    spoilt = F.when(C("event_id") % 10 == 0, F.concat(C("text"), F.lit(":x"))).otherwise(C("text"))
    return s.withColumn("minutes", sc.minutes_running(spoilt))


@query("hemisphere_p5", "cells", "SELECT stem, regexp_matches(stem, '[_-]LH([_-]|$)') AS left_side, count(*) AS n FROM cells GROUP BY ALL")
def hemisphere(spark, folder):
    return fx.cells(spark, folder).groupBy("stem").agg(F.count("*").alias("n")).withColumn("left_side", sc.is_left_hemisphere(C("stem")))


@query("bird_key_p6", "cells", "SELECT split_part(stem, '_', 1) AS bird, count(*) AS n FROM cells GROUP BY 1")
def bird_key(spark, folder):
    return fx.cells(spark, folder).groupBy(sc.bird_of(C("stem")).alias("bird")).agg(F.count("*").alias("n"))


@query("stale_flag_p7", "sections section_times", """
SELECT s.section_id, coalesce(regions_mtime > counts_mtime, false) AS stale, coalesce(counts_mtime > TIMESTAMP '1998-06-01', false) AS counted_since
FROM sections s LEFT JOIN section_times t ON t.section_id = s.section_id""")
def stale_flag(spark, folder):
    j = fx.sections(spark, folder).join(fx.section_times(spark, folder), "section_id", "left")
    return j.select("section_id", sc.newer(C("regions_mtime"), C("counts_mtime")).alias("stale"),
                    sc.newer(C("counts_mtime"), F.lit("1998-06-01").cast("timestamp_ntz")).alias("counted_since"))


@query("membership_flags_p8", "", """
SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '5-LOW') AS blank_canvas, c.c_custkey IS NOT NULL AS has_first_pass
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON c.c_custkey = o_custkey""")
def membership_flags(spark, folder):
    known = fx.table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(C("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    return fx.table(spark, folder, "orders").join(known, "o_custkey", "left").select(
        "o_orderkey", C("o_orderpriority").isin("1-URGENT", "5-LOW").alias("blank_canvas"), F.coalesce("known", F.lit(False)).alias("has_first_pass"))


@query("cell_identity_p9", "", """
SELECT CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS y, CAST(round_even(l_quantity * 1.5::DOUBLE, 0) AS BIGINT) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def cell_identity(spark, folder):
    return fx.table(spark, folder, "lineitem").groupBy(
        sc.pixel_of(C("l_quantity") / 2).alias("y"), sc.pixel_of(C("l_quantity") * 1.5).alias("x")).agg(F.count("*").alias("n"))


@query("to_canvas_p10", "cells", """
SELECT least(greatest(CAST(round_even(y * 1.25::DOUBLE, 0) AS BIGINT), 0), 479) AS cy, least(greatest(CAST(round_even(x * 1.25::DOUBLE - 10, 0) AS BIGINT), 0), 479) AS cx,
  count(*) AS n FROM cells GROUP BY 1, 2""")
def to_canvas(spark, folder):
    return fx.cells(spark, folder).groupBy(sc.clipped_pixel(C("y") * 1.25).alias("cy"), sc.clipped_pixel(C("x") * 1.25 - 10).alias("cx")).agg(F.count("*").alias("n"))


@query("full_patch_p11", "cells", "SELECT stem, count(*) FILTER (y >= 40 AND y < 440 AND x >= 40 AND x < 440) AS full_patches, count(*) AS n FROM cells GROUP BY stem")
def full_patch(spark, folder):
    return fx.cells(spark, folder).groupBy("stem").agg(
        F.count_if(sc.has_full_patch(C("y"), C("x"), 480, 480, 40)).alias("full_patches"), F.count("*").alias("n"))


@query("candidate_budget_p12", "sections", """
SELECT section_id, CAST(round_even(350 / pow(0.3088427408547889::DOUBLE / 1000, 2) / 1e6::DOUBLE * (size_px * 100 * pow(0.35::DOUBLE / 1000, 2)), 0) AS BIGINT) AS wanted,
  size_px * 0.35::DOUBLE / 100 > 480 AS too_big, CAST(ceil(sqrt(size_px / 20000.0::DOUBLE)) AS BIGINT) AS stride FROM sections""")
def candidate_budget(spark, folder):
    s = fx.sections(spark, folder)
    return s.select("section_id", sc.candidates_wanted(C("size_px") * 100, F.lit(0.35)).alias("wanted"), (C("size_px") * 0.35 / 100 > 480).alias("too_big"),
                    F.ceil(F.sqrt(C("size_px") / 20000.0)).alias("stride"))


@query("area_and_density_p13", "section_cells", """
WITH a AS (SELECT section_id, region, count(*) AS n, CAST(sum(weight) * 100000 AS BIGINT) AS px, CASE WHEN section_id % 9 = 0 THEN NULL ELSE 0.5::DOUBLE END AS um FROM section_cells GROUP BY 1, 2)
SELECT section_id, region, round_even(px * pow(um / 1000, 2), 4) AS area_mm2, round_even(n / nullif(px * pow(um / 1000, 2), 0), 1) AS density_per_mm2 FROM a""")
def area_and_density(spark, folder):
    a = fx.section_cells(spark, folder).groupBy("section_id", "region").agg(F.count("*").alias("n"), (F.sum("weight") * 100000).alias("px"))
    um = F.when(C("section_id") % 9 != 0, 0.5)
    exact = C("px") * F.pow(um / 1000.0, F.lit(2.0))
    return a.select("section_id", "region", sc.area_mm2(C("px"), um).alias("area_mm2"), sc.density(C("n"), exact).alias("density_per_mm2"))


@query("brightness_p14", "pixels", "SELECT image, count(*) FILTER (green >= 0.02::DOUBLE) AS bright, count(*) AS n FROM pixels GROUP BY image")
def brightness(spark, folder):
    return fx.pixels(spark, folder).groupBy("image").agg(F.count_if(C("green") >= 0.02).alias("bright"), F.count("*").alias("n"))


@query("line_coordinates_p15", "pixels bands", """
WITH c AS (SELECT image, y, x, round(normal_y * (x - 30) - normal_x * (y - 20), 6) AS across, round(normal_y * (y - 20) + normal_x * (x - 30), 6) AS along FROM pixels JOIN bands USING (image))
SELECT image, y, x, across, along, across > 0 AS keep FROM c""")
def line_coordinates(spark, folder):
    j = fx.pixels(spark, folder).join(fx.bands(spark, folder), "image")
    args = (C("y"), C("x"), F.lit(20), F.lit(30), C("normal_y"), C("normal_x"))
    across = F.round(sc.across_line(*args), 6)
    return j.select("image", "y", "x", across.alias("across"), F.round(sc.along_line(*args), 6).alias("along"), (across > 0).alias("keep"))


@query("band_frame_p16", "framed", "SELECT image, y, x, round(along, 5) AS along, round(across, 5) AS across FROM framed")
def band_frame(spark, folder):
    return fx.framed(spark, folder).select("image", "y", "x", F.round("along", 5).alias("along"), F.round("across", 5).alias("across"))


@query("atlas_bins_p17", "framed", """
SELECT image, least(greatest(CAST(floor((along + 3000) / 100) AS BIGINT), 0), 59) * 70 + least(greatest(CAST(floor((across + 4000) / 100) AS BIGINT), 0), 69) AS bin,
  abs(along) < 3000 AND across > -4000 AND across < 3000 AS in_range, count(*) AS n FROM framed GROUP BY ALL""")
def atlas_bins(spark, folder):
    return fx.framed(spark, folder).groupBy("image", frames.bin_index(C("along"), C("across")).alias("bin"), frames.in_atlas(C("along"), C("across")).alias("in_range")).agg(F.count("*").alias("n"))


@query("convex_region_p18", "framed", """
SELECT image, y, x, list_aggregate([cos(2 * pi() * k / 16) * along + sin(2 * pi() * k / 16) * across <= 120 + 5 * k for k in range(0, 16)], 'bool_and') AS inside FROM framed""")
def convex_region(spark, folder):
    offsets = F.array(*[F.lit(120.0 + 5 * k) for k in range(16)])
    return fx.framed(spark, folder).select("image", "y", "x", frames.inside_polygon(frames.projections(C("along"), C("across")), offsets).alias("inside"))


@query("segment_distance_p19", "edges", """
WITH s AS (SELECT *, CASE WHEN y1 = y2 AND x1 = x2 THEN 0 ELSE least(greatest(((240 - y1) * (y2 - y1) + (240 - x1) * (x2 - x1)) / CAST((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1) AS DOUBLE), 0), 1) END AS t FROM edges)
SELECT region, vertex, round(sqrt(pow(240 - y1 - t * (y2 - y1), 2) + pow(240 - x1 - t * (x2 - x1), 2)), 6) AS distance FROM s""")
def segment_distance(spark, folder):
    from stratafold.operators import polygons

    e = polygons.edges(fx.verts(spark, folder), ["region"])
    return e.select("region", "vertex", F.round(sc.distance_to_segment(F.lit(240), F.lit(240), C("y1"), C("x1"), C("y2"), C("x2")), 6).alias("distance"))


@query("rotated_box_p20", "pixels bands", """
WITH a AS (SELECT *, 0.5 * atan2(normal_y, normal_x) AS t FROM pixels JOIN bands USING (image))
SELECT image, y, x, abs(sin(t) * (y - 25) + cos(t) * (x - 32)) <= 20 AND abs(sin(t) * (x - 32) - cos(t) * (y - 25)) <= 10 AS inside FROM a""")
def rotated_box(spark, folder):
    j = fx.pixels(spark, folder).join(fx.bands(spark, folder), "image")
    return j.select("image", "y", "x", sc.inside_box(C("y"), C("x"), F.lit(25), F.lit(32), F.lit(20), F.lit(10), C("normal_y"), C("normal_x")).alias("inside"))


@query("refine_angle_p21", "", """
WITH a AS (SELECT event_id, value AS prior, CAST(event_id * 37 % 360 AS DOUBLE) AS candidate FROM events),
s AS (SELECT *, (candidate - prior + 90) - 180 * floor((candidate - prior + 90) / 180) - 90 AS swing FROM a)
SELECT event_id, CASE WHEN abs(swing) <= 45 THEN candidate ELSE prior END AS angle FROM s""")
def refine_angle(spark, folder):
    e = fx.table(spark, folder, "events")
    return e.select("event_id", sc.refine_angle(C("value"), (C("event_id") * 37 % 360).cast("double")).alias("angle"))


@query("orient_normal_p22", "framed bands", """
WITH p AS (SELECT f.image, normal_y * (y - 25) + normal_x * (x - 32) AS d FROM framed f JOIN bands b ON b.image = f.image WHERE green >= 0.1::DOUBLE),
m AS (SELECT image, (quantile_cont(d, 0.1) + quantile_cont(d, 0.9)) / 2 AS middle FROM p GROUP BY image)
SELECT image, round(CASE WHEN normal_y * (10 - 25) + normal_x * (image % 64 - 32) > middle THEN normal_y ELSE -normal_y END, 6) AS normal_y,
  round(CASE WHEN normal_y * (10 - 25) + normal_x * (image % 64 - 32) > middle THEN normal_x ELSE -normal_x END, 6) AS normal_x FROM m JOIN bands USING (image)""")
def orient_normal(spark, folder):
    from stratafold.operators.moments import orient

    patch = fx.pixels(spark, folder).filter("green >= 0.1")
    b = fx.bands(spark, folder).withColumn("marker_y", F.lit(10)).withColumn("marker_x", C("image") % 64)
    return orient(patch, b, 50, 64).select("image", F.round("normal_y", 6).alias("normal_y"), F.round("normal_x", 6).alias("normal_x"))


@query("setting_labels_p23", "", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'inf' WHEN p_size % 2 = 0 THEN concat(p_size * 8, '@', printf('%.2f', (p_size % 3) / 4.0::DOUBLE)) ELSE concat(p_size * 8, 'u') END AS label,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.05::DOUBLE * p_retailprice END AS backset_um FROM part""")
def setting_labels(spark, folder):
    part = fx.table(spark, folder, "part")
    um = (C("p_size") * 8).cast("string")
    label = (F.when(C("p_size") % 5 == 0, "inf").when(C("p_size") % 2 == 0, F.concat(um, F.lit("@"), F.format_string("%.2f", (C("p_size") % 3) / 4.0)))
             .otherwise(F.concat(um, F.lit("u"))))
    backset = F.when(C("p_size") % 2 == 0, C("p_size").cast("double")).otherwise(F.lit(0.05) * C("p_retailprice"))
    return part.select("p_partkey", label.alias("label"), backset.alias("backset_um"))


@query("frame_grid_p24", "bands", """
SELECT image, CAST(r.i AS BIGINT) AS row, CAST(c.i AS BIGINT) AS col, round(25 + ((r.i - 10) * 2) * normal_y - ((c.i - 10) * 2) * normal_x, 6) AS y, round(32 + ((r.i - 10) * 2) * normal_x + ((c.i - 10) * 2) * normal_y, 6) AS x
FROM bands, range(0, 20) r(i), range(0, 20) c(i)""")
def frame_grid(spark, folder):
    b = fx.bands(spark, folder)
    g = frames.grid(b, "image", 20, 20).join(b, "image")
    across, along = (C("row") - 10) * 2, (C("column") - 10) * 2
    return g.select("image", C("row").cast("long").alias("row"), C("column").cast("long").alias("col"),
                    F.round(25 + across * C("normal_y") - along * C("normal_x"), 6).alias("y"), F.round(32 + across * C("normal_x") + along * C("normal_y"), 6).alias("x"))


@query("patch_standardise_p25", "", """
SELECT vec_id, i - 1 AS position, round((embedding[i] - list_avg(embedding)) / (list_stddev_pop(embedding) + 1e-6::DOUBLE), 4) AS value FROM embeddings, range(1, 65) r(i)""")
def patch_standardise(spark, folder):
    from stratafold.functions.arrays import standardise

    e = fx.table(spark, folder, "embeddings").select("vec_id", standardise(C("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("position", "value")).select("vec_id", C("position").cast("long").alias("position"), F.round("value", 4).alias("value"))


@query("patch_cut_p26", "pixels", """
WITH cand AS (SELECT image, y, x FROM pixels WHERE green > 0.3::DOUBLE AND y >= 3 AND y < 47 AND x >= 3 AND x < 61)
SELECT c.image, c.y, c.x, round(avg(p.green), 6) AS mean, count(*) AS n, round(avg(p.green) FILTER (abs(2 * (p.y - c.y) + 1) < 4 AND abs(2 * (p.x - c.x) + 1) < 4), 6) AS crop_mean
FROM cand c JOIN pixels p ON p.image = c.image AND p.y >= c.y - 3 AND p.y < c.y + 3 AND p.x >= c.x - 3 AND p.x < c.x + 3 GROUP BY c.image, c.y, c.x""")
def patch_cut(spark, folder):
    from stratafold.operators.raster import cut_patches

    p = fx.pixels(spark, folder)
    ok = p.filter(C("green") > 0.3).filter(sc.has_full_patch(C("y"), C("x"), 50, 64, 3)).select("image", C("y").alias("cy"), C("x").alias("cx"))
    patch = cut_patches(p, ok, 3)
    middle = C("dy").between(-2, 1) & C("dx").between(-2, 1)
    middle = (F.abs(2 * C("dy") + 1) < 4) & (F.abs(2 * C("dx") + 1) < 4)
    return patch.groupBy("image", C("cy").alias("y"), C("cx").alias("x")).agg(
        F.round(F.avg("green"), 6).alias("mean"), F.count("*").alias("n"), F.round(F.avg(F.when(middle, C("green"))), 6).alias("crop_mean"))
