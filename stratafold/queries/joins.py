"""Registered queries: membership, matching and lookups."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.constants import ALREADY_QUEUED, ALREADY_RUNNING, COUNTED_SINCE, COUNTING_NOW, COUNTING_OUTSIDE, GONE, NO_DORSAL, NO_REGIONS
from stratafold.functions.scalars import has_full_patch, region_rank
from stratafold.operators import matching, polygons, tables
from stratafold.plans import queueing
from stratafold.queries.sources import DIFF_SQL, STATUS, _diff
from stratafold.registry import query

C = F.col


def _masks(spark, folder):
    return polygons.polygon_masks(fx.verts(spark, folder), ["k", "region"], 480, 480)


def _points(spark, folder):
    return fx.cells(spark, folder).select("k", "y", "x").distinct()


@query("point_in_polygon_j1", "inside_pairs", "SELECT k, y, x, region FROM inside_pairs")
def point_in_polygon(spark, folder):
    return polygons.pixels_in_masks(fx.cells(spark, folder), _masks(spark, folder), ["k"]).select("k", "y", "x", "region")


@query("cells_per_polygon_j2", "inside_pairs cells", """
SELECT i.region, count(*) AS cells FROM inside_pairs i JOIN cells c ON c.k = i.k AND c.y = i.y AND c.x = i.x GROUP BY i.region""")
def cells_per_polygon(spark, folder):
    """A cell in two outlines counts in both: cells are tallied per pixel first, then summed over the outlines."""
    weight = fx.cells(spark, folder).groupBy("k", "y", "x").agg(F.count("*").alias("n"))
    return polygons.counts_in_masks(weight, _masks(spark, folder), ["k"], "region").withColumnRenamed("n", "cells")


@query("first_region_j2", "inside_pairs", "SELECT k, y, x, min(region) AS region, count(*) - 1 AS shared FROM inside_pairs GROUP BY k, y, x")
def first_region(spark, folder):
    return polygons.pixels_in_masks(fx.cells(spark, folder), _masks(spark, folder), ["k"]).groupBy("k", "y", "x").agg(
        F.min("region").alias("region"), (F.count("*") - 1).alias("shared"))


def numbers(spark, folder):
    return tables.numbers_table(fx.sections(spark, folder), fx.section_cells(spark, folder), fx.section_areas(spark, folder))


NUMBERS_SQL = f"""
WITH n AS (SELECT section_id, region, count(*) AS n FROM section_cells GROUP BY 1, 2),
numbers AS (SELECT s.section_id, s.stem, split_part(s.stem, '_', 1) AS bird, r.region, {STATUS} AS status, CASE WHEN has_counts THEN coalesce(n.n, 0) END AS cells,
  a.area_mm2, CASE WHEN has_counts THEN round_even(coalesce(n.n, 0) / nullif(a.area_mm2, 0), 1) END AS density_per_mm2,
  has_counts AND has_regions AND coalesce(regions_mtime > t.counts_mtime, false) AS stale
FROM sections s CROSS JOIN regions3 r LEFT JOIN n ON n.section_id = s.section_id AND n.region = r.region
LEFT JOIN section_areas a ON a.section_id = s.section_id AND a.region = r.region LEFT JOIN section_times t ON t.section_id = s.section_id)
"""
NUMBERS_VIEWS = "sections section_cells section_areas section_times regions3"


@query("numbers_table_j3", NUMBERS_VIEWS, NUMBERS_SQL + "SELECT * FROM numbers")
def numbers_table(spark, folder):
    return numbers(spark, folder)


@query("new_points_j4", "points edits", """
SELECT DISTINCT e.k, e.y, e.x FROM edits e WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.k = e.k AND (p.y - e.y) * (p.y - e.y) + (p.x - e.x) * (p.x - e.x) <= 225)""")
def new_points(spark, folder):
    return matching.farther_than(fx.edits(spark, folder).select("k", "y", "x").distinct(), _points(spark, folder), ["k"])


LABEL_SQL = """
WITH cand AS (SELECT DISTINCT k, y, x FROM cells), ann AS (SELECT DISTINCT k, y, x FROM edits),
pairs AS (SELECT c.k, c.y, c.x, a.y AS ty, a.x AS tx, (c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x) AS d2 FROM cand c JOIN ann a ON a.k = c.k
  WHERE abs(c.y - a.y) <= 15 AND abs(c.x - a.x) <= 15 AND (c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x) <= 225),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, y, x ORDER BY d2, ty, tx) AS rn FROM pairs) WHERE rn = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY k, ty, tx ORDER BY d2, y, x) AS br FROM near),
labelled AS (SELECT c.k, c.y, c.x, CASE WHEN b.br = 1 THEN 1 ELSE 0 END AS label, coalesce(b.br > 1, false) AS duplicate, round(sqrt(b.d2), 6) AS distance
  FROM cand c LEFT JOIN best b ON b.k = c.k AND b.y = c.y AND b.x = c.x)
"""


@query("label_candidates_j5", "cells edits", LABEL_SQL + """
SELECT *, y >= 40 AND y < 440 AND x >= 40 AND x < 440 AND NOT duplicate AND ((y > 20 AND y < 459 AND x > 20 AND x < 459) OR label = 1) AND NOT (y > 300 AND x > 300) AS usable FROM labelled""")
def label_candidates(spark, folder):
    out = matching.label_candidates(_points(spark, folder), fx.edits(spark, folder), ["k"])
    interior = C("y").between(21, 458) & C("x").between(21, 458)
    excluded = (C("y") > 300) & (C("x") > 300)
    return out.withColumn("distance", F.round("distance", 6)).withColumn(
        "usable", has_full_patch(C("y"), C("x"), 480, 480, 40) & ~C("duplicate") & (interior | (C("label") == 1)) & ~excluded)


@query("accepted_proposals_j6", "cells edits", """
WITH p AS (SELECT k, y, x, CASE WHEN source = 'hand' THEN 1 ELSE 0 END AS label, count(*) AS n FROM cells GROUP BY ALL),
fp AS (SELECT DISTINCT k, y, x FROM edits WHERE k % 5 <> 0)
SELECT p.k, p.label, count(*) AS points, count(*) FILTER (label = 1 AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.k = p.k AND abs(fp.y - p.y) <= 15 AND abs(fp.x - p.x) <= 15
   AND (fp.y - p.y) * (fp.y - p.y) + (fp.x - p.x) * (fp.x - p.x) <= 225)) AS proposed FROM p GROUP BY p.k, p.label""")
def accepted_proposals(spark, folder):
    label = F.when(C("source") == "hand", 1).otherwise(0)
    p = fx.cells(spark, folder).select("k", "y", "x", label.alias("label")).distinct()
    first_pass = fx.edits(spark, folder).filter("k % 5 <> 0")
    return matching.accepted_proposals(p, first_pass, "k").groupBy("k", "label").agg(F.count("*").alias("points"), F.count_if("proposed").alias("proposed"))


@query("edit_diff_j7", "cells edits", DIFF_SQL + "SELECT stem, y, x, region, round(probability, 6) AS probability, source, change FROM diff")
def edit_diff(spark, folder):
    return _diff(spark, folder).withColumn("probability", F.round("probability", 6))


@query("batch_plan_j8", "sections", f"""
SELECT section_id AS position, stem, CASE WHEN NOT has_regions THEN '{NO_REGIONS}' WHEN NOT has_dorsal THEN '{NO_DORSAL}' WHEN owner % 101 = 1 THEN '{ALREADY_RUNNING}'
  WHEN owner % 7 = 0 THEN '{ALREADY_QUEUED}' WHEN owner % 4 = 0 THEN '{COUNTING_OUTSIDE}' END AS reason FROM sections""")
def batch_plan(spark, folder):
    s = fx.sections(spark, folder)
    out = queueing.batch(s, s.filter("owner % 101 = 1"), s.filter("owner % 7 = 0"), s.filter("owner % 4 = 0"))
    return out.select(C("section_id").alias("position"), "stem", "reason")


@query("restore_queue_j8", "sections section_times", f"""
WITH q AS (SELECT section_id AS position, CASE WHEN owner % 13 = 0 THEN concat(stem, '_moved') ELSE stem END AS stem, regions_mtime AS saved_at FROM sections WHERE owner % 2 = 1)
SELECT q.position, q.stem, CASE WHEN s.stem IS NULL THEN '{GONE}' WHEN s.owner % 4 = 3 THEN '{COUNTING_NOW}' WHEN t.counts_mtime > q.saved_at THEN '{COUNTED_SINCE}'
  WHEN NOT s.has_regions THEN '{NO_REGIONS}' WHEN NOT s.has_dorsal THEN '{NO_DORSAL}' END AS reason
FROM q LEFT JOIN sections s ON s.stem = q.stem LEFT JOIN section_times t ON t.section_id = s.section_id""")
def restore_queue(spark, folder):
    s = fx.sections(spark, folder).join(fx.section_times(spark, folder), "section_id", "left")
    moved = F.when(C("owner") % 13 == 0, F.concat("stem", F.lit("_moved"))).otherwise(C("stem"))
    q = fx.sections(spark, folder).filter("owner % 2 = 1").select(C("section_id").alias("position"), moved.alias("stem"), C("regions_mtime").alias("saved_at"))
    return queueing.restorable(q, s, s.filter("owner % 4 = 3"))


@query("jobs_by_section_j11", "images", """
WITH s AS (SELECT concat('B', o_custkey % 7, '_LH_', o_custkey) AS stem FROM images GROUP BY 1),
led AS (SELECT event_id AS seq, event_id + 1000 AS pid, CAST(floor(value) AS BIGINT) AS minutes, concat('B', user_id * 3 % 7, '_LH_', user_id * 3, '.tif') AS file FROM events)
SELECT s.stem, arg_min(pid, seq) AS pid, arg_min(minutes, seq) AS minutes FROM s JOIN led ON led.file = concat(s.stem, '.tif') GROUP BY s.stem""")
def jobs_by_section(spark, folder):
    key = C("o_custkey")
    stem = F.concat(F.lit("B"), (key % 7).cast("string"), F.lit("_LH_"), key.cast("string"))
    sections = fx.table(spark, folder, "orders").select(stem.alias("stem")).distinct().withColumn("file", F.concat("stem", F.lit(".tif")))
    user = C("user_id") * 3
    command = F.concat(F.lit("python count.py /data/birds/B"), (user % 7).cast("string"), F.lit("_LH_"), user.cast("string"), F.lit(".tif --threshold 0.5"))
    ledger = fx.table(spark, folder, "events").select(C("event_id").alias("seq"), (C("event_id") + 1000).alias("pid"), F.floor("value").alias("minutes"), command.alias("command"))
    return queueing.jobs_by_section(sections, ledger)


@query("resample_lookup_j9", "pixels bands", """
WITH g AS (SELECT image, CAST(r.i AS BIGINT) AS row, CAST(c.i AS BIGINT) AS col, CAST(round_even(25 + (r.i - 10) * 2.3::DOUBLE * normal_y - (c.i - 10) * 2.3::DOUBLE * normal_x, 0) AS BIGINT) AS y,
  CAST(round_even(32 + (r.i - 10) * 2.3::DOUBLE * normal_x + (c.i - 10) * 2.3::DOUBLE * normal_y, 0) AS BIGINT) AS x FROM bands, range(0, 24) r(i), range(0, 20) c(i))
SELECT g.image, row, col, coalesce(p.green, -1) AS value FROM g LEFT JOIN pixels p ON p.image = g.image AND p.y = g.y AND p.x = g.x""")
def resample_lookup(spark, folder):
    from stratafold.operators import frames
    from stratafold.operators.raster import lookup

    b = fx.bands(spark, folder)
    g = frames.grid(b, "image", 24, 20).join(b, "image")
    across, along = (C("row") - 10) * F.lit(2.3), (C("column") - 10) * F.lit(2.3)
    at = g.select("image", "row", "column", (25 + across * C("normal_y") - along * C("normal_x")).alias("y"), (32 + across * C("normal_x") + along * C("normal_y")).alias("x"))
    found = lookup(at, fx.pixels(spark, folder), "green", F.lit(-1.0))
    return found.select("image", C("row").cast("long").alias("row"), C("column").cast("long").alias("col"), C("green").alias("value"))


@query("unwarp_mask_j9", "framed", """
WITH m AS (SELECT i.image, r.i AS row, c.i AS col FROM (SELECT DISTINCT image FROM framed) i, range(0, 24) r(i), range(0, 20) c(i) WHERE (r.i * 7 + c.i * 3 + i.image) % 5 < 2)
SELECT f.image, f.y, f.x, m.image IS NOT NULL AS inside FROM framed f LEFT JOIN m ON m.image = f.image
  AND m.row = CAST(round_even((240 - f.across) / 20.0::DOUBLE - 0.5::DOUBLE, 0) AS BIGINT) AND m.col = CAST(round_even((f.along + 200) / 20.0::DOUBLE - 0.5::DOUBLE, 0) AS BIGINT)""")
def unwarp_mask(spark, folder):
    from stratafold.operators import frames

    f = fx.framed(spark, folder)
    mask = frames.grid(f, "image", 24, 20).filter((C("row") * 7 + C("column") * 3 + C("image")) % 5 < 2)
    return frames.unwarp(mask, f, 240.0, 200.0, 20.0).select("image", "y", "x", "inside")


@query("paint_bins_j10", "framed", """
WITH f AS (SELECT *, CASE WHEN abs(along) < 3000 AND abs(across + 500) < 3500 THEN least(greatest(CAST(floor((along + 3000) / 100) AS BIGINT), 0), 59) * 70 + least(greatest(CAST(floor((across + 4000) / 100) AS BIGINT), 0), 69) END AS bin FROM framed),
v AS (SELECT bin, avg(CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS voters FROM f WHERE tissue AND bin IS NOT NULL GROUP BY bin)
SELECT f.image, f.y, f.x, coalesce(v.share >= 0.5::DOUBLE AND v.voters >= 20, false) AS painted FROM f LEFT JOIN v ON v.bin = f.bin""")
def paint_bins(spark, folder):
    from stratafold.plans.atlas import paint, votes, with_bins

    f = with_bins(fx.framed(spark, folder), keep_outside=True)
    return paint(f, votes(f.filter("tissue AND bin IS NOT NULL"), C("lab") == 1), 0.5, 20).select("image", "y", "x", "painted")


@query("mask_algebra_j12", "framed", """
SELECT image, count(*) FILTER (tissue AND across > 0) AS near_side, count(*) FILTER (tissue AND across < -160) AS far_side, count(*) FILTER (tissue AND across <= 0 AND across >= -160) AS strip,
  count(*) FILTER (tissue AND across > 0 AND lab <> 2) AS without_second, count(*) FILTER (lab = 1 OR (tissue AND across > 0)) AS union_px FROM framed GROUP BY image""")
def mask_algebra(spark, folder):
    near, far = C("tissue") & (C("across") > 0), C("tissue") & (C("across") < -160)
    return fx.framed(spark, folder).groupBy("image").agg(
        F.count_if(near).alias("near_side"), F.count_if(far).alias("far_side"), F.count_if(C("tissue") & ~(C("across") > 0) & ~(C("across") < -160)).alias("strip"),
        F.count_if(near & (C("lab") != 2)).alias("without_second"), F.count_if((C("lab") == 1) | near).alias("union_px"))


@query("marker_on_canvas_j13", "sections edits", """
WITH m AS (SELECT k, arg_min(y, event_id) AS y, arg_min(x, event_id) AS x FROM edits WHERE k % 3 <> 0 GROUP BY k)
SELECT s.section_id, m.y * 0.35::DOUBLE / 8 AS y, m.x * 0.35::DOUBLE / 8 AS x FROM sections s LEFT JOIN m ON m.k = s.section_id % 42""")
def marker_on_canvas(spark, folder):
    from stratafold.sources.readers import first_point

    m = first_point(fx.edits(spark, folder).filter("k % 3 <> 0").withColumnRenamed("event_id", "seq"), "k")
    s = fx.sections(spark, folder).select("section_id", (C("section_id") % 42).alias("k"))
    return s.join(m, "k", "left").select("section_id", (C("y") * 0.35 / 8).alias("y"), (C("x") * 0.35 / 8).alias("x"))
