"""Straight-edged shapes: hand-made regions with known numbers, and cases without evidence."""

import pytest
from pyspark.sql import functions as F

from stratafold.plans import shapes

COLUMNS = "image int, y int, x int, along double, across double, tissue boolean, lab int"


def framed(spark, region, images=1, tissue=lambda a, c: True):
    """Pixels of 10 um; ``region(along, across)`` gives the label."""
    rows = []
    for image in range(images):
        for y in range(60):
            for x in range(60):
                along, across = 10.0 * (x - 30), 10.0 * (y - 30)
                rows.append((image, y, x, along, across, tissue(along, across), region(along, across)))
    return spark.createDataFrame(rows, COLUMNS)


def slanted(along, across):
    """In front of the band from 50 to 200, behind it from -80 to -240; both low ends run outwards by a tenth of the depth."""
    if 50 <= across <= 200 and -150 - 0.1 * (across - 50) <= along <= 120:
        return 1
    return 2 if -240 <= across <= -80 and -150 + 0.1 * (across + 80) <= along <= 120 else 0


def test_measures_of_both_sides(spark):
    f = framed(spark, slanted)
    front = shapes.measures(f, F.col("lab") == 1, 1, 60.0, 20.0).first()
    assert (front.line, front.gap, front.share, front.depth, front.high, front.slope_high) == (50.0, 50.0, None, 150.0, pytest.approx(120), pytest.approx(0))
    assert front.slope_low == pytest.approx(-0.1, abs=0.03) and front.low == pytest.approx(-150, abs=10)
    back = shapes.measures(f, F.col("lab") == 2, -1, 60.0, 20.0).first()
    assert (back.line, back.gap, back.depth, back.high) == (-80.0, 20.0, 160.0, pytest.approx(120))
    assert back.share == pytest.approx(80 / 590) and back.slope_low == pytest.approx(0.1, abs=0.03)


def test_line_is_the_middle_of_a_tilted_side_and_not_its_corner(spark):
    f = framed(spark, lambda a, c: int(0.2 * a <= c <= 250 and abs(a) <= 150))
    got = shapes.measures(f, F.col("lab") == 1, 1, 60.0, 40.0).first()
    assert abs(got.line) <= 10.0 and got.depth == 250.0 - got.line


def test_small_or_absent_regions_have_no_measures(spark):
    assert shapes.measures(framed(spark, lambda a, c: 0), F.col("lab") == 1, 1, 60.0).count() == 0
    assert shapes.measures(framed(spark, lambda a, c: int(abs(a) <= 20 and 0 <= c <= 20)), F.col("lab") == 1, 1, 60.0, 20.0).count() == 0


def test_relative_numbers_give_the_region_back(spark):
    f = framed(spark, slanted, tissue=lambda a, c: abs(a) <= 250 and abs(c) <= 280)
    for side, sign in ((1, 1), (2, -1)):
        own = shapes.relative_measures(f, shapes.measures(f, F.col("lab") == side, sign, 60.0, 20.0), sign)
        again = shapes.sized_by_tissue(f, own.withColumn("near", F.col("line")), sign).first()
        want = own.first()
        assert (again.low, again.high, again.depth) == (pytest.approx(want.low), pytest.approx(want.high), pytest.approx(want.depth))
        assert "f_low" not in again.asDict()


def test_line_behind_the_band_goes_by_share_or_by_gap(spark):
    f = framed(spark, slanted, images=2)
    k = spark.createDataFrame([(0, 5.0, 0.5), (1, 5.0, None)], "image int, gap double, share double")
    got = {r.image: r.near for r in shapes.near_line(f, k, -1, 60.0).collect()}
    assert got == {0: -295.0, 1: -65.0}
    assert {r.near for r in shapes.near_line(f, k, 1, 60.0).collect()} == {5.0}


def test_no_span_without_tissue_behind_the_line(spark):
    f = framed(spark, slanted, tissue=lambda a, c: c < 0)
    near = spark.createDataFrame([(0, 10.0)], "image int, near double")
    assert shapes.tissue_span(f, near, 1).count() == 0
    assert shapes.tissue_span(f, near.withColumn("near", F.lit(-10.0)), -1, 50.0).first().asDict() == {"image": 0, "span_low": -300.0, "span_high": 290.0, "span_depth": 290.0}


def test_march_stops_at_black_and_at_the_end_of_tissue(spark):
    near = spark.createDataFrame([(0, 0.0)], "image int, near double")
    f = framed(spark, slanted, tissue=lambda a, c: a < 200)
    assert shapes.marched_end(f, near, F.lit(False)).first().stop == 180.0
    assert shapes.marched_end(f, near, F.col("along").between(100, 119)).first().stop == 80.0
    assert shapes.marched_end(f, near, F.col("along").between(20, 39)).first().stop == 0.0
    assert shapes.marched_end(framed(spark, slanted, tissue=lambda a, c: a > 50), near, F.lit(False)).count() == 0
    assert shapes.marched_end(f, near, F.lit(False), least_px=100_000).count() == 0
    k = spark.createDataFrame([(0, 120.0, 30.0), (1, 120.0, 30.0), (2, 120.0, None)], "image int, high double, high_offset double")
    stops = spark.createDataFrame([(0, 180.0), (2, 180.0)], "image int, stop double")
    assert {r.image: r.high for r in shapes.with_marched_high(k, stops).collect()} == {0: 135.0, 1: 120.0, 2: 120.0}


def test_growth_keeps_what_reaches_the_line(spark):
    f = framed(spark, lambda a, c: int(abs(a) <= 200 and 0 <= c <= 200))
    wall = f.filter(F.col("across") == 100.0)
    near = spark.createDataFrame([(0, 0.0)], "image int, near double")
    region = f.filter("lab = 1")
    speck = f.filter("along = 0 AND across = 50")
    grown = shapes.grown_from_line(region, f, wall.unionByName(speck), near, 60, 60, 20.0)
    assert {r.y for r in grown.select("y").distinct().collect()} == set(range(30, 40)) and grown.count() == 41 * 10  # the hole is filled
    far = near.withColumn("near", F.lit(-290.0))
    assert shapes.grown_from_line(region, f, wall, far, 60, 60, 20.0).count() == 41 * 10  # the largest piece
    assert shapes.grown_from_line(region, f, f, near, 60, 60, 20.0).count() == region.count()


def test_polygon_slides_onto_its_line(spark):
    f = framed(spark, slanted)
    box = [(0, k, 100.0) for k in range(16)]
    offsets = spark.createDataFrame(box, "image int, k int, offset double")
    near = spark.createDataFrame([(0, 30.0)], "image int, near double")
    moved = {r.k: r.offset for r in shapes.slid_onto_line(offsets, f, near, 1).collect()}
    assert moved[4] - 100.0 == pytest.approx(-(moved[12] - 100.0)) and moved[0] == pytest.approx(100.0)
    assert moved[4] == pytest.approx(100.0 + 30.0 - -100.0)
    short = {r.k: r.offset for r in shapes.slid_onto_line(offsets, f, near, 1, leash_um=50.0).collect()}
    assert short[4] == pytest.approx(150.0)
    gone = shapes.slid_onto_line(offsets.withColumn("offset", F.lit(-500.0)), f, near, 1)
    assert {r.offset for r in gone.collect()} == {-500.0}


def test_cut_keeps_the_line_itself(spark):
    f = framed(spark, slanted)
    near = spark.createDataFrame([(0, 100.0)], "image int, near double")
    kept = shapes.cut_at_line(f.filter("lab = 1"), near, 1)
    assert kept.agg(F.min("across")).first()[0] == 100.0 and kept.columns == f.columns
    assert shapes.cut_at_line(f.filter("lab = 1"), near, -1).agg(F.max("across")).first()[0] == 100.0
