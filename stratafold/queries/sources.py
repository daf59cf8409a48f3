"""Registered queries: scans, readers and sinks."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.functions.scalars import density, region_rank, scale_from_metadata
from stratafold.operators import matching, polygons, tables
from stratafold.registry import query
from stratafold.session import shared_path
from stratafold.sources import catalog, readers, sinks, versions

IMAGES = """
WITH img AS (
  SELECT path, modified, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem, len(string_split(path, '/')) AS depth FROM files
  WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('tif', 'tiff') AND NOT regexp_matches(path, '/\\.[^/]*/')
    AND NOT regexp_matches(path, '/(\\.venv|__pycache__|runs|wandb|node_modules|archive|lambda archive|old)/')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY depth, lower(path), path) AS rn, count(*) OVER (PARTITION BY stem) AS n,
           first_value(path) OVER (PARTITION BY stem ORDER BY depth, lower(path), path) AS winner FROM img)
"""
SIDE = """, side AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]+) (regions|dorsal|counted cells)\\.csv$', 1) AS stem,
         CASE regexp_extract(path, ' (regions|dorsal|counted cells)\\.csv$', 1) WHEN 'counted cells' THEN 'counts'
         ELSE regexp_extract(path, ' (regions|dorsal|counted cells)\\.csv$', 1) END AS kind, modified
  FROM files WHERE path LIKE '%.csv')
"""
STATUS = """CASE WHEN NOT has_regions THEN 'needs regions' WHEN NOT has_dorsal THEN 'needs dorsal marker'
WHEN NOT has_counts THEN 'ready to count' ELSE 'counted' END"""
SECTION_TABLE = IMAGES + SIDE + f""", flat AS (
  SELECT i.stem, i.path, coalesce(bool_or(s.kind = 'regions'), false) AS has_regions, coalesce(bool_or(s.kind = 'dorsal'), false) AS has_dorsal,
         coalesce(bool_or(s.kind = 'counts'), false) AS has_counts,
         coalesce(max(s.modified) FILTER (s.kind = 'regions') > max(s.modified) FILTER (s.kind = 'counts'), false) AS stale
  FROM (SELECT * FROM ranked WHERE rn = 1) i
  LEFT JOIN side s ON s.stem = i.stem AND s.folder = regexp_extract(i.path, '^(.*)/[^/]*$', 1) GROUP BY i.stem, i.path)
SELECT *, {STATUS} AS status FROM flat"""


@query("catalog_scan_s1", "files", IMAGES + "SELECT stem, path, modified, n - 1 AS duplicates FROM ranked WHERE rn = 1")
def catalog_scan(spark, folder):
    return catalog.resolve_images(fx.files(spark, folder))


@query("catalog_duplicates_s1", "files", IMAGES + "SELECT path AS loser, winner FROM ranked WHERE rn > 1")
def catalog_duplicates(spark, folder):
    return catalog.duplicate_images(fx.files(spark, folder))


@query("skip_rule_s2", "files", """SELECT path, regexp_matches(path, '/\\.[^/]*/') OR
  regexp_matches(path, '/(\\.venv|__pycache__|runs|wandb|node_modules|archive|lambda archive|old)/') AS skipped FROM files""")
def skip_rule(spark, folder):
    return fx.files(spark, folder).select("path", catalog.in_skipped_folder(F.col("path")).alias("skipped"))


@query("section_table_s3", "files", SECTION_TABLE)
def section_table(spark, folder):
    return catalog.section_table(fx.files(spark, folder))


@query("sidecar_names_s4", "files", "WITH x AS (SELECT 1)" + SIDE + "SELECT stem, kind, count(*) AS n, max(modified) AS newest FROM side GROUP BY stem, kind")
def sidecar_names(spark, folder):
    return catalog.sidecar_files(fx.files(spark, folder)).groupBy("stem", "kind").agg(F.count("*").alias("n"), F.max("modified").alias("newest"))


@query("polygon_reader_s5", "edges", "SELECT region, vertex, y1 AS y, x1 AS x, y2 AS next_y, x2 AS next_x FROM edges")
def polygon_reader(spark, folder):
    return polygons.edges(fx.verts(spark, folder), ["region"]).select(
        "region", "vertex", F.col("y1").alias("y"), F.col("x1").alias("x"), F.col("y2").alias("next_y"), F.col("x2").alias("next_x"))


def _written(frames, path):
    """Sidecar files, each frame with a header of its own; one per stem where rows have an order, else as the rows lie; read from all."""
    for i, frame in enumerate(frames):
        order = [c for c in frame.columns if c.startswith("_")]
        rows = frame.repartition("stem").sortWithinPartitions("stem", *order).drop(*order) if order else frame
        rows.write.partitionBy("stem").option("header", True).csv(f"{path}/{i}")
    return f"{path}/*/stem=*", F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "/stem=([^/]*)/", 1)


@query("polygon_files_s5", "verts", """
SELECT 'B' || CAST(region // 10 AS VARCHAR) AS stem, CAST(region AS VARCHAR) AS region,
       row_number() OVER (PARTITION BY region // 10 ORDER BY region, vertex) - 1 AS vertex, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x,
       CASE WHEN region // 10 % 2 = 0 AND vertex % 3 <> 0 THEN 'hand' ELSE 'model' END AS source FROM verts""")
def polygon_files(spark, folder):
    """Region files with and without a source, under two names for the coordinates; the file's order is the vertex order."""
    v = fx.verts(spark, folder).select(
        F.concat(F.lit("B"), F.floor(F.col("region") / 10).cast("string")).alias("stem"), F.floor(F.col("region") / 10) % 2 == 0, "region", "vertex", "y", "x").toDF(
        "stem", "even", "region", "vertex", "y", "x")
    named = v.select("stem", "even", F.col("region").alias("_region"), F.col("vertex").alias("_vertex"), "region", F.col("y").alias("axis-0"), F.col("x").alias("axis-1"))
    with_source = named.filter("even").drop("even").withColumn("source", F.when(F.col("_vertex") % 3 == 0, "model").otherwise("hand"))
    plain = named.filter("NOT even").select("stem", "_region", "_vertex", F.col("axis-1").alias("x"), F.col("axis-0").alias("y"), "region")
    path, stem = _written([with_source, plain], shared_path(spark, "polygon-files"))
    read = readers.good_rows(readers.read_table(spark, "regions", path, stem))
    return readers.with_source(read).select("stem", "region", "vertex", "y", "x", "source")


@query("count_files_s9", "cells", """
SELECT stem, region, CASE WHEN k % 2 = 0 THEN source ELSE 'model' END AS source, count(*) AS n, CAST(sum(y) AS BIGINT) AS ys, CAST(sum(x) AS BIGINT) AS xs,
       round(sum(probability), 4) AS p FROM cells GROUP BY 1, 2, 3""")
def count_files(spark, folder):
    """Count files of five columns, and older ones of four whose coordinates are written as 5.0; a missing source means the model."""
    c = fx.cells(spark, folder)
    new = c.filter("k % 2 = 0").select("stem", F.col("y").alias("axis-0"), F.col("x").alias("axis-1"), "region", "probability", "source")
    old = c.filter("k % 2 = 1").select("stem", F.col("y").cast("double").alias("axis-0"), F.col("x").cast("double").alias("axis-1"), "region", "probability")
    path, stem = _written([new, old], shared_path(spark, "count-files"))
    read = readers.with_source(readers.good_rows(readers.read_table(spark, "counts", path, stem)))
    return read.groupBy("stem", "region", "source").agg(
        F.count("*").alias("n"), F.sum("y").alias("ys"), F.sum("x").alias("xs"), F.round(F.sum("probability"), 4).alias("p"))


@query("label_corpus_s6", "edges", """
WITH a AS (SELECT region // 2 AS section, region % 2 AS part, abs(sum(y1 * x2 - x1 * y2)) / 2.0 AS area FROM edges
           WHERE region % 7 <> 0 GROUP BY region HAVING count(*) >= 3)
SELECT section, max(area) FILTER (part = 0) AS ncm, max(area) FILTER (part = 1) AS cmm,
       round(max(area) FILTER (part = 1) / nullif(max(area) FILTER (part = 0), 0), 6) AS ratio FROM a GROUP BY section""")
def label_corpus(spark, folder):
    vertices = readers.label_outlines(fx.verts(spark, folder).withColumn("source", F.when(F.col("region") % 7 == 0, "model")))
    areas = polygons.polygon_area(polygons.edges(vertices, ["region"]), ["region"]).filter("vertices >= 3")
    part = F.col("region") % 2
    return areas.groupBy(F.floor(F.col("region") / 2).alias("section")).agg(
        F.max(F.when(part == 0, F.col("area"))).alias("ncm"), F.max(F.when(part == 1, F.col("area"))).alias("cmm")).withColumn(
        "ratio", F.round(F.col("cmm") / F.nullif("ncm", F.lit(0.0)), 6))


@query("region_tables_s6", "files", IMAGES + SIDE + """, c AS (
  SELECT s.stem, s.folder, s.folder <> regexp_extract(r.path, '^(.*)/[^/]*$', 1) AS away FROM side s JOIN ranked r ON r.rn = 1 AND r.stem = s.stem WHERE s.kind = 'regions')
SELECT stem, first(folder ORDER BY away, folder) AS folder, count(*) AS copies FROM c GROUP BY stem""")
def region_tables(spark, folder):
    return catalog.one_table_per_stem(fx.files(spark, folder))


@query("first_marker_s7", "edits", """SELECT stem, arg_min(y, event_id) AS y, arg_min(x, event_id) AS x FROM edits GROUP BY stem""")
def first_marker(spark, folder):
    return readers.first_point(fx.edits(spark, folder).withColumnRenamed("event_id", "seq"), "stem")


@query("two_markers_s7", "edits", """
WITH r AS (SELECT k, action, logged_at, y, x, row_number() OVER (PARTITION BY stem, action ORDER BY event_id) AS rn, stem FROM edits)
SELECT a.stem, a.action, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM r a JOIN r b ON a.stem = b.stem AND a.action = b.action AND a.rn = 1 AND b.rn = 2""")
def two_markers(spark, folder):
    return readers.first_two_points(fx.edits(spark, folder).withColumnRenamed("event_id", "seq"), "stem", "action")


@query("annotation_reader_s8", "cells edits", """
SELECT DISTINCT k, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, 'first' AS pass FROM cells
UNION ALL SELECT DISTINCT k, CAST(y AS DOUBLE), CAST(x AS DOUBLE), 'extra' FROM edits""")
def annotation_reader(spark, folder):
    first = fx.cells(spark, folder).select("k", F.col("y").alias("axis-0"), F.col("x").alias("axis-1"))
    extra = fx.edits(spark, folder).select("k", F.col("y").alias("image-axis-0"), F.col("x").alias("image-axis-1"), F.lit(0).alias("axis-0"), F.lit(0).alias("axis-1"))
    read = [readers.coordinates(t).select("k", "y", "x").distinct().withColumn("pass", F.lit(n)) for t, n in ((first, "first"), (extra, "extra"))]
    return read[0].unionByName(read[1])


@query("source_default_s9", "cells", "SELECT stem, coalesce(nullif(source, 'model'), 'model') AS source, count(*) AS n FROM cells GROUP BY ALL")
def source_default(spark, folder):
    old = fx.cells(spark, folder).withColumn("source", F.nullif("source", F.lit("model")))
    return readers.with_source(old).groupBy("stem", "source").agg(F.count("*").alias("n"))


@query("fallback_cells_s10", "section_cells", """
WITH a AS (SELECT section_id, count(*) AS n FROM section_cells WHERE source = 'model' GROUP BY 1),
b AS (SELECT section_id, count(*) AS n FROM section_cells WHERE source = 'hand' AND weight % 2 = 1 GROUP BY 1)
SELECT section_id, 'counted' AS used, n FROM a UNION ALL SELECT section_id, 'hand', n FROM b WHERE section_id NOT IN (SELECT section_id FROM a)""")
def fallback_cells(spark, folder):
    c = fx.section_cells(spark, folder).select("section_id", "source", "weight", "y", "x")
    chosen = readers.prefer(c.filter("source = 'model'"), c.filter("source = 'hand' AND weight % 2 = 1"), "section_id")
    return chosen.groupBy("section_id", "used").agg(F.count("*").alias("n"))


@query("area_cache_s11", "section_areas", """SELECT section_id, region, area_mm2, tissue_px, area_mm2 IS NULL AS unknown_scale FROM section_areas""")
def area_cache(spark, folder):
    return fx.section_areas(spark, folder).withColumn("unknown_scale", F.col("area_mm2").isNull())


@query("scale_from_metadata_s12", "", """
SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_retailprice / 4000
  ELSE CASE WHEN p_partkey % 2 = 0 THEN 25400.0::DOUBLE ELSE 10000.0::DOUBLE END / nullif((p_size % 5) * 1000 / 3.0::DOUBLE, 0) END, 6) AS um_per_pixel FROM part""")
def scale_query(spark, folder):
    part = fx.table(spark, folder, "part")
    text = F.when(F.col("p_size") % 7 == 0, None).when(
        F.col("p_size") % 3 == 0, F.concat(F.lit('<Pixels PhysicalSizeX="'), (F.col("p_retailprice") / 4000).cast("string"), F.lit('" SizeC="3">'))).otherwise("plain")
    return part.select("p_partkey", F.round(scale_from_metadata(
        text, (F.col("p_size") % 5) * 1000, F.lit(3), (2 + F.col("p_partkey") % 2)), 6).alias("um_per_pixel"))


@query("raster_green_s13", "pixels", """
SELECT image, y, CASE WHEN image % 2 = 0 THEN x // 4 ELSE x END AS x, round(floor((green + 1) * 127) / 255, 6) AS green FROM pixels
WHERE image % 2 = 1 OR x % 4 = 1""")
def raster_green(spark, folder):
    p = fx.pixels(spark, folder)
    colour = F.col("image") % 2 == 0
    raw = p.select("image", "y", F.when(colour, F.floor(F.col("x") / 4)).otherwise(F.col("x")).alias("x"),
                   F.when(colour, F.col("x") % 4).otherwise(0).alias("c"), F.floor((F.col("green") + 1) * 127).alias("v"))
    return readers.raster_green(raw).withColumn("green", F.round("green", 6))


@query("exclusion_mask_s14", "points inside_pairs edges", """
WITH ok AS (SELECT region FROM edges GROUP BY region HAVING count(*) >= 3),
hit AS (SELECT DISTINCT k, y, x FROM inside_pairs SEMI JOIN ok USING (region))
SELECT p.k, p.y, p.x, h.k IS NOT NULL AS excluded FROM points p LEFT JOIN hit h ON p.k = h.k AND p.y = h.y AND p.x = h.x""")
def exclusion_mask(spark, folder):
    points = fx.cells(spark, folder).select("k", "y", "x").distinct()
    masks = polygons.polygon_masks(fx.verts(spark, folder), ["k", "region"], 480, 480)
    return polygons.covered_by_masks(points, masks, ["k"], "excluded")


@query("reviewed_area_s15", "outlines outline_edges", """
WITH n AS (SELECT section_id, count(*) AS n FROM outlines GROUP BY 1),
pts AS (SELECT DISTINCT section_id, x AS y, y AS x FROM outlines),
poly AS (SELECT p.section_id, p.y, p.x, count(*) % 2 = 1 AS inside FROM pts p JOIN outline_edges e ON p.section_id = e.section_id
   AND (e.y1 <= p.y) <> (e.y2 <= p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(CAST(e.y2 - e.y1 AS DOUBLE), 0) GROUP BY 1, 2, 3),
lines AS (SELECT section_id, min_by(y, vertex) AS y0, min_by(x, vertex) AS x0, max_by(y, vertex) AS y1, max_by(x, vertex) AS x1 FROM outlines GROUP BY 1 HAVING count(*) = 2),
sided AS (SELECT *, (x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0) AS side, (x1 - x0) * (240 - y0) - (y1 - y0) * (240 - x0) AS centre FROM pts p JOIN lines USING (section_id))
SELECT section_id, y, x, 'line' AS kind, CASE WHEN centre > 0 THEN side > 0 ELSE side < 0 END AS inside FROM sided
UNION ALL SELECT p.section_id, p.y, p.x, 'polygon', coalesce(q.inside, false) FROM pts p JOIN n ON n.section_id = p.section_id AND n.n >= 3
LEFT JOIN poly q ON q.section_id = p.section_id AND q.y = p.y AND q.x = p.x
UNION ALL SELECT p.section_id, p.y, p.x, 'refused', NULL FROM pts p JOIN n ON n.section_id = p.section_id AND n.n < 2""")
def reviewed_area(spark, folder):
    rows = fx.outline_rows(spark, folder).select("section_id", F.struct("vertex", "y", "x").alias("corner"), F.struct(F.col("x").alias("y"), F.col("y").alias("x")).alias("point"))
    both = polygons.points_inside(rows, ["section_id"], 480, 480)
    line = polygons.half_plane(F.col("y"), F.col("x"), F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x"), 480, 480)
    n = F.col("vertices")
    return both.select(
        "section_id", "y", "x", F.when(n == 2, "line").when(n >= 3, "polygon").otherwise("refused").alias("kind"),
        F.when(n == 2, line).when(n >= 3, F.col("inside")).alias("inside"))


def _summary(spark, folder):
    return fx.section_cells(spark, folder).filter("source = 'model'").groupBy(F.col("section_id").alias("image"), "region").agg(
        F.count("*").alias("detected"), F.count_if(F.col("probability") >= 0.5).alias("classified"), F.sum("weight").alias("tissue_px"))


def _run(spark, folder):
    return fx.section_cells(spark, folder).filter("source = 'hand' AND weight > 25").groupBy(F.col("section_id").alias("image"), "region").agg(
        F.count("*").alias("detected"), F.max("logged_at").alias("logged_at"))


RUN_SQL = """
WITH ex AS (SELECT section_id AS image, region, count(*) AS detected, count(*) FILTER (probability >= 0.5::DOUBLE) AS classified, CAST(sum(weight) AS BIGINT) AS tissue_px
            FROM section_cells WHERE source = 'model' GROUP BY 1, 2),
run AS (SELECT section_id AS image, region, count(*) AS detected, max(logged_at) AS logged_at FROM section_cells WHERE source = 'hand' AND weight > 25 GROUP BY 1, 2)
"""


@query("whole_write_s16", "section_areas", "SELECT section_id, region, tissue_px FROM section_areas")
def whole_write(spark, folder):
    """Written twice through the staging name; what is read back is one complete table."""
    path = shared_path(spark, "areas")
    rows = fx.section_areas(spark, folder).select("section_id", "region", "tissue_px")
    sinks.write_whole(rows.filter("region = 'CMM'"), path)
    sinks.write_whole(rows, path)
    return spark.read.parquet(path)


@query("previous_generation_s17", "section_areas", "SELECT section_id, region, tissue_px FROM section_areas WHERE region = 'CMM'")
def previous_generation(spark, folder):
    """The table that was about to be replaced is kept, one generation deep."""
    path = shared_path(spark, "areas")
    rows = fx.section_areas(spark, folder).select("section_id", "region", "tissue_px")
    for kept in ("dNCM", "CMM", "vNCM"):
        sinks.write_whole(rows.filter(F.col("region") == kept), path, keep_previous=True)
    return spark.read.parquet(f"{path}.previous")


@query("summary_upsert_s18", "section_cells", RUN_SQL + """
SELECT image, region, detected, classified, tissue_px, CAST(NULL AS TIMESTAMP) AS logged_at, 'kept' AS origin FROM ex WHERE image NOT IN (SELECT image FROM run)
UNION ALL SELECT image, region, detected, NULL, NULL, logged_at, 'run' FROM run""")
def summary_upsert(spark, folder):
    return sinks.merge_run(_summary(spark, folder), _run(spark, folder))


@query("versioned_upsert_s18", "section_cells", RUN_SQL + """
SELECT image, region, detected, classified, tissue_px, CAST(NULL AS TIMESTAMP) AS logged_at FROM ex WHERE image NOT IN (SELECT image FROM run)
UNION ALL SELECT image, region, detected, NULL, NULL, logged_at FROM run""")
def versioned_upsert(spark, folder):
    """The run committed as a version of its own on top of the table's; run twice, the second time changes nothing."""
    path = shared_path(spark, "summary")
    versions.write_version(_summary(spark, folder), path, buckets=16)
    versions.upsert(_run(spark, folder), path)
    versions.upsert(_run(spark, folder), path)
    return versions.read_version(spark, path)


@query("earlier_version_s17", "section_cells", RUN_SQL + "SELECT image, region, detected, classified, tissue_px FROM ex")
def earlier_version(spark, folder):
    """What the table said before the last commit."""
    path = shared_path(spark, "summary")
    first = versions.write_version(_summary(spark, folder), path, buckets=16)
    versions.upsert(_run(spark, folder), path)
    return versions.read_version(spark, path, first)


@query("upsert_counts_s18", "section_cells", RUN_SQL + """
SELECT count(*) FILTER (image NOT IN (SELECT image FROM run)) AS kept, count(*) FILTER (image IN (SELECT image FROM run)) AS replaced FROM ex""")
def upsert_counts(spark, folder):
    return sinks.merge_counts(_summary(spark, folder), _run(spark, folder))


@query("run_history_s18", "section_cells", RUN_SQL + """SELECT image, region, detected, logged_at, TIMESTAMP '2024-05-01 10:00:00' AS counted_at FROM run""")
def run_history(spark, folder):
    return sinks.stamped(_run(spark, folder), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))


@query("area_rows_s19", "section_areas", """SELECT section_id, region, area_mm2, tissue_px,
  row_number() OVER (PARTITION BY section_id ORDER BY CASE region WHEN 'dNCM' THEN 0 WHEN 'vNCM' THEN 1 ELSE 2 END) AS position FROM section_areas""")
def area_rows(spark, folder):
    ranked = fx.section_areas(spark, folder).withColumn("r", region_rank(F.col("region")))
    present = ranked.groupBy("section_id").agg(F.collect_set("r").alias("ranks"))
    at = F.size(F.filter("ranks", lambda q: q <= F.col("r"))).cast("long")
    return ranked.join(present, "section_id").select("section_id", "region", "area_mm2", "tissue_px", at.alias("position"))


def _diff(spark, folder):
    """Cells as saved against an edited layer; a raster of region names says where new cells fall."""
    original = fx.cells(spark, folder).select("stem", "y", "x", "region", "probability", "source")
    layer = fx.edits(spark, folder).filter("action = 'added'").select("stem", "y", "x")
    names = F.when(F.col("y") < 160, "dNCM").when(F.col("y") < 320, "vNCM").when(F.col("y") < 400, "CMM")
    regions = layer.distinct().withColumn("region", names).filter("region IS NOT NULL")
    return matching.edit_diff(original, layer, regions)


DIFF_SQL = """
WITH shown AS (SELECT DISTINCT stem, y, x FROM edits WHERE action = 'added'),
known AS (SELECT c.stem, c.y, c.x, c.region, c.probability, c.source, CASE WHEN s.stem IS NULL THEN 'removed' ELSE 'kept' END AS change
          FROM cells c LEFT JOIN shown s ON s.stem = c.stem AND s.y = c.y AND s.x = c.x),
fresh AS (SELECT stem, y, x, CASE WHEN y < 160 THEN 'dNCM' WHEN y < 320 THEN 'vNCM' WHEN y < 400 THEN 'CMM' END AS region FROM shown
          WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.stem = shown.stem AND c.y = shown.y AND c.x = shown.x)),
diff AS (SELECT * FROM known UNION ALL SELECT stem, y, x, region, CASE WHEN region IS NOT NULL THEN 1.0::DOUBLE END,
          CASE WHEN region IS NOT NULL THEN 'hand' END, CASE WHEN region IS NULL THEN 'outside' ELSE 'added' END FROM fresh)
"""


@query("edit_log_s20", "cells edits", DIFF_SQL + """
SELECT TIMESTAMP '2024-05-01 10:00:00' AS logged_at, change AS action, stem, y, x, region, round(probability, 6) AS probability FROM diff WHERE change IN ('added', 'removed')""")
def edit_log(spark, folder):
    d = _diff(spark, folder)
    log = sinks.edit_rows(d.filter("change = 'added'"), d.filter("change = 'removed'"), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    return log.withColumn("probability", F.round("probability", 6))


@query("summary_after_edits_s21", "section_cells section_areas", """
WITH base AS (SELECT c.section_id AS image, c.region, count(*) AS detected, count(*) FILTER (c.probability >= 0.5::DOUBLE) AS classified, any_value(a.area_mm2) AS area_mm2
  FROM section_cells c LEFT JOIN section_areas a ON a.section_id = c.section_id AND a.region = c.region GROUP BY 1, 2),
e AS (SELECT section_id AS image, region, count(*) FILTER (weight > 25) AS plus, count(*) FILTER (weight <= 25) AS minus FROM section_cells WHERE source = 'hand' GROUP BY 1, 2),
now AS (SELECT section_id AS image, region, count(*) AS n FROM section_cells WHERE NOT (source = 'hand' AND weight <= 25) GROUP BY 1, 2)
SELECT b.image, b.region, b.detected, b.area_mm2, CASE WHEN b.image IN (SELECT image FROM e) THEN coalesce(n.n, 0) ELSE b.classified END AS classified,
  CASE WHEN b.image IN (SELECT image FROM e) AND b.area_mm2 <> 0 THEN round_even(coalesce(n.n, 0) / b.area_mm2, 1) ELSE round_even(b.classified / b.area_mm2, 1) END AS density_per_mm2,
  CASE WHEN b.image IN (SELECT image FROM e) THEN concat('+', coalesce(e.plus, 0), '-', coalesce(e.minus, 0)) END AS hand_edits
FROM base b LEFT JOIN e ON e.image = b.image AND e.region = b.region LEFT JOIN now n ON n.image = b.image AND n.region = b.region""")
def summary_after_edits(spark, folder):
    c = fx.section_cells(spark, folder).withColumnRenamed("section_id", "image")
    summary = c.groupBy("image", "region").agg(F.count("*").alias("detected"), F.count_if(F.col("probability") >= 0.5).alias("classified")).join(
        fx.section_areas(spark, folder).withColumnRenamed("section_id", "image"), ["image", "region"], "left").withColumn(
        "density_per_mm2", density(F.col("classified"), F.col("area_mm2")))
    hand = c.filter("source = 'hand'")
    moved = hand.withColumn("action", F.when(F.col("weight") > 25, "added").otherwise("removed"))
    present = c.filter("NOT (source = 'hand' AND weight <= 25)")
    return sinks.summary_after_edits(summary, present, moved)


@query("save_differences_s22", "cells", """
WITH a AS (SELECT stem, region, y, x, count(*) AS n FROM cells GROUP BY ALL), b AS (SELECT stem, region, y, x, count(*) AS n FROM cells WHERE source = 'model' GROUP BY ALL)
SELECT stem, region, y, x, a.n - coalesce(b.n, 0) AS surplus FROM a LEFT JOIN b USING (stem, region, y, x) WHERE a.n - coalesce(b.n, 0) <> 0""")
def save_differences(spark, folder):
    c = fx.cells(spark, folder)
    columns = ("stem", "region", "y", "x")
    return sinks.row_differences(c.select(*columns), c.filter("source = 'model'").select(*columns))


@query("vertex_sink_s23", "verts", """
WITH saved AS (SELECT k AS stem, region, 0 AS shape, vertex, CASE WHEN region % 3 = 0 AND y > 400 THEN y + 1 ELSE y END AS y, x FROM verts WHERE region % 11 <> 0
  UNION ALL SELECT k, region, 1, vertex, y, x FROM verts WHERE region % 11 <> 0 AND y < 20),
n AS (SELECT stem, region, shape, count(*) AS n FROM saved GROUP BY 1, 2, 3 HAVING count(*) >= 3),
moved AS (SELECT k AS stem, region, bool_or(region % 3 = 0 AND y > 400) AS edited FROM verts GROUP BY 1, 2)
SELECT s.stem, s.region, s.shape, s.vertex, s.y, s.x, CASE WHEN s.shape = 0 AND NOT m.edited THEN 'model' ELSE 'hand' END AS source
FROM saved s JOIN n USING (stem, region, shape) JOIN moved m ON m.stem = s.stem AND m.region = s.region
UNION ALL SELECT k, region, 0, vertex, y, x, 'carried' FROM verts WHERE region % 11 = 0""")
def vertex_sink(spark, folder):
    v = fx.verts(spark, folder).withColumnRenamed("k", "stem")
    shown = v.filter("region % 11 <> 0")
    first = shown.withColumn("y", F.when((F.col("region") % 3 == 0) & (F.col("y") > 400), F.col("y") + 1).otherwise(F.col("y"))).withColumn("shape", F.lit(0))
    second = shown.filter("y < 20").withColumn("shape", F.lit(1))
    carried = v.filter("region % 11 = 0").withColumn("shape", F.lit(0)).withColumn("source", F.lit("carried"))
    return sinks.vertex_provenance(first.unionByName(second), shown, carried)


@query("export_text_s24", "section_areas", """SELECT concat_ws(chr(9), CAST(section_id AS VARCHAR), region, coalesce(CAST(area_mm2 AS VARCHAR), ''), CAST(tissue_px AS VARCHAR)) AS line FROM section_areas""")
def export_text(spark, folder):
    rows = fx.section_areas(spark, folder).select("section_id", "region", "area_mm2", "tissue_px")
    return rows.select(sinks.export_line(rows).alias("line"))


@query("section_register_s25", "", """
SELECT o_orderkey AS section_id, c_name AS bird, c_mktsegment AS quality, c_custkey IS NOT NULL AS registered FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def section_register(spark, folder):
    dimension = fx.table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("bird"), F.col("c_mktsegment").alias("quality"), F.lit(True).alias("registered"))
    return fx.table(spark, folder, "orders").join(dimension, "o_custkey", "left").select(
        F.col("o_orderkey").alias("section_id"), "bird", "quality", F.coalesce("registered", F.lit(False)).alias("registered"))


@query("resolve_fragment_s26", "sections", """
WITH w AS (SELECT DISTINCT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'b' END, CAST(s_suppkey % 7 AS VARCHAR), '_LH_', CAST(s_suppkey AS VARCHAR)) AS fragment FROM supplier),
e AS (SELECT fragment FROM w WHERE fragment IN (SELECT stem FROM sections)),
p AS (SELECT fragment, count(stem) AS matches, min(stem) AS stem FROM w LEFT JOIN sections ON contains(lower(stem), lower(fragment))
      WHERE fragment NOT IN (SELECT fragment FROM e) GROUP BY fragment)
SELECT fragment, CAST(1 AS BIGINT) AS matches, fragment AS stem FROM e UNION ALL SELECT fragment, matches, CASE WHEN matches = 1 THEN stem END FROM p""")
def resolve_fragment(spark, folder):
    key = F.col("s_suppkey")
    wanted = fx.table(spark, folder, "supplier").select(F.concat(
        F.when(key % 2 == 0, "B").otherwise("b"), (key % 7).cast("string"), F.lit("_LH_"), key.cast("string")).alias("fragment"))
    return catalog.resolve_fragments(wanted, fx.sections(spark, folder))


@query("patch_archive_s27", "", "SELECT vec_id AS patch_id, label, len(embedding) = 64 AS right_size, round(CAST(list_sum(embedding) AS DOUBLE), 3) AS total FROM embeddings")
def patch_archive(spark, folder):
    e = fx.table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("patch_id"), "label", (F.size("embedding") == 64).alias("right_size"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"))


@query("canvas_drift_s28", "outline_edges", """
WITH cr AS (SELECT section_id, r.y AS y, least(greatest(CAST(ceil(x1 + (r.y - y1) * (x2 - x1) / CAST(y2 - y1 AS DOUBLE)) AS BIGINT), 0), 480) AS c
  FROM outline_edges e, range(0, 480) r(y) WHERE (y1 <= r.y) <> (y2 <= r.y)),
s AS (SELECT section_id, c, row_number() OVER (PARTITION BY section_id, y ORDER BY c DESC) AS rn FROM cr),
px AS (SELECT section_id, CAST(sum(CASE WHEN rn % 2 = 1 THEN c ELSE -c END) AS BIGINT) AS pixels FROM s GROUP BY 1),
sh AS (SELECT section_id, abs(sum(y1 * x2 - x1 * y2)) / 2.0 AS area FROM outline_edges GROUP BY 1)
SELECT sh.section_id, coalesce(px.pixels, 0) AS pixels, sh.area, round(coalesce(px.pixels, 0) / nullif(sh.area, 0) - 1, 6) AS drift FROM sh LEFT JOIN px USING (section_id)""")
def canvas_drift(spark, folder):
    e = polygons.edges(fx.outlines(spark, folder), ["section_id"])
    drawn = polygons.drawn_pixels(e, ["section_id"], 480, 480)
    exact = polygons.polygon_area(e, ["section_id"]).drop("vertices")
    pixels = F.coalesce("pixels", F.lit(0))
    return exact.join(drawn, "section_id", "left").select(
        "section_id", pixels.alias("pixels"), "area", F.round(pixels / F.nullif("area", F.lit(0.0)) - 1, 6).alias("drift"))


@query("stale_areas_s30", "sections section_times", """
SELECT stem, regions_mtime AS version FROM sections s LEFT JOIN section_times t ON t.section_id = s.section_id WHERE t.counts_mtime IS NULL OR date_trunc('year', t.counts_mtime) <> date_trunc('year', regions_mtime)""")
def stale_areas(spark, folder):
    s = fx.sections(spark, folder)
    done = s.join(fx.section_times(spark, folder), "section_id").select("stem", F.when(
        F.date_trunc("year", "counts_mtime") == F.date_trunc("year", "regions_mtime"), F.col("regions_mtime")).alias("version"))
    return sinks.stale_areas(done, s.select("stem", F.col("regions_mtime").alias("version")))


@query("remembered_queue_s31", "", """
SELECT o_orderkey AS position, concat('B', CAST(o_custkey % 7 AS VARCHAR), '_LH_', CAST(o_orderkey AS VARCHAR)) AS stem, o_orderdate AS saved_at
FROM orders WHERE o_orderpriority = '2-HIGH'""")
def remembered_queue(spark, folder):
    o = fx.table(spark, folder, "orders")
    queue = o.select(F.col("o_orderpriority").alias("folder"), F.col("o_orderkey").alias("position"), F.concat(
        F.lit("B"), (F.col("o_custkey") % 7).cast("string"), F.lit("_LH_"), F.col("o_orderkey").cast("string")).alias("stem"), F.col("o_orderdate").alias("saved_at"))
    return sinks.remembered(queue, "2-HIGH")
