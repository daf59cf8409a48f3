"""Point matching by distance on pixel grids: every step works on distinct pixels, so copies of one point cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.constants import HAND_PROBABILITY, MATCH_RADIUS


def near_pairs(left: DataFrame, right: DataFrame, scope: list[str], radius: int = MATCH_RADIUS) -> DataFrame:
    """Pairs of distinct whole pixels ``(ly, lx), (ry, rx)`` of the same scope within ``radius``.

    Right pixels are spread over the 3x3 neighbouring cells of a grid as wide as the radius and met by equality, never by
    a cross join. A grid cell has at most ``radius**2`` distinct pixels, so the work per cell is bounded by the geometry.
    """
    a = left.select(*scope, F.col("y").alias("ly"), F.col("x").alias("lx")).distinct().withColumn(
        "gy", F.floor(F.col("ly") / radius)).withColumn("gx", F.floor(F.col("lx") / radius))
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(*scope, F.col("y").alias("ry"), F.col("x").alias("rx")).distinct().withColumn("s", F.explode(step)).select(
        *scope, "ry", "rx", (F.floor(F.col("ry") / radius) + F.col("s.i")).alias("gy"), (F.floor(F.col("rx") / radius) + F.col("s.j")).alias("gx"))
    squared = (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")) + (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx"))
    return a.join(b, [*scope, "gy", "gx"]).withColumn("d2", squared).filter(F.col("d2") <= radius * radius).drop("gy", "gx")


def farther_than(extra: DataFrame, existing: DataFrame, scope: list[str], radius: int = MATCH_RADIUS) -> DataFrame:
    """Rows of ``extra`` with no existing point within the radius. Scopes without existing points keep all their rows."""
    close = near_pairs(extra, existing, scope, radius).select(*scope, F.col("ly").alias("y"), F.col("lx").alias("x")).distinct()
    return extra.join(close, [*scope, "y", "x"], "left_anti")


def _code(d2: Column, dy: Column, dx: Column, radius: int) -> Column:
    """A squared distance and an offset of whole pixels as one number in their order: its minimum is kept in place, that of a struct is sorted for."""
    side = 2 * radius + 1
    return ((d2 * side + dy + radius) * side + dx + radius).cast("long")


def _decoded(code: Column, radius: int) -> tuple[Column, Column, Column]:
    side = 2 * radius + 1
    row = F.floor(code / side)
    return F.floor(code / (side * side)), row % side - radius, code % side - radius


def nearest_pixel(points: DataFrame, targets: DataFrame, scope: list[str], radius: int = MATCH_RADIUS) -> DataFrame:
    """Per distinct point pixel the nearest target within the radius; ties go to the smaller (y, x)."""
    pairs = near_pairs(points, targets, scope, radius)
    code = _code(F.col("d2"), F.col("ry") - F.col("ly"), F.col("rx") - F.col("lx"), radius)
    types = dict(pairs.dtypes)
    d2, dy, dx = _decoded(F.col("n"), radius)
    return pairs.groupBy(*scope, "ly", "lx").agg(F.min(code).alias("n")).select(
        *scope, F.col("ly").alias("y"), F.col("lx").alias("x"), d2.cast(types["d2"]).alias("d2"),
        (F.col("ly") + dy).cast(types["ry"]).alias("ty"), (F.col("lx") + dx).cast(types["rx"]).alias("tx"))


def label_candidates(candidates: DataFrame, annotations: DataFrame, scope: list[str], radius: int = MATCH_RADIUS) -> DataFrame:
    """Candidate pixels with ``label`` and ``duplicate``: the closest candidate of each annotation is 1, its other near ones are duplicates.

    The window over an annotation holds no more rows than its circle has pixels; the pairs are made once.
    """
    keys = [*scope, "y", "x"]
    near = nearest_pixel(candidates, annotations, scope, radius)
    code = _code(F.col("d2"), F.col("y") - F.col("ty"), F.col("x") - F.col("tx"), radius)
    flagged = near.withColumn("best", code == F.min(code).over(Window.partitionBy(*scope, "ty", "tx"))).select(*keys, "d2", "best")
    return candidates.select(*keys).distinct().join(flagged, keys, "left").select(
        *keys, F.when(F.col("best"), 1).otherwise(0).alias("label"), F.coalesce(~F.col("best"), F.lit(False)).alias("duplicate"),
        F.sqrt("d2").alias("distance"))


def accepted_proposals(points: DataFrame, first_pass: DataFrame, group: str, radius: int = MATCH_RADIUS) -> DataFrame:
    """Adds ``proposed``: a positive without a first-pass click within the radius. Groups without a first pass are all proposed.

    Negatives are never proposed.
    """
    close = near_pairs(points.filter("label = 1"), first_pass, [group], radius).select(
        group, F.col("ly").alias("y"), F.col("lx").alias("x")).distinct().withColumn("_near", F.lit(True))
    return points.join(close, [group, "y", "x"], "left").withColumn(
        "proposed", (F.col("label") == 1) & F.col("_near").isNull()).drop("_near")


def edit_diff(original: DataFrame, layers: DataFrame, regions: DataFrame, scope: str = "stem") -> DataFrame:
    """What an edited layer says the count is now, one row per result: ``change`` is kept, added, removed or outside.

    Layer points are whole pixels and a pixel is used once. All original rows of a pixel stay or go together; a new pixel
    takes its region from ``regions(scope, y, x, region)`` with probability 1 and source ``hand``, or is outside.
    """
    keys = [scope, "y", "x"]
    shown = layers.select(*keys).distinct().withColumn("_shown", F.lit(True))
    known = original.join(shown, keys, "left").withColumn("change", F.when(F.col("_shown"), "kept").otherwise("removed")).drop("_shown")
    fresh = shown.join(original.select(*keys).distinct(), keys, "left_anti").join(regions, keys, "left").select(
        *keys, "region", F.when(F.col("region").isNotNull(), HAND_PROBABILITY).alias("probability"),
        F.when(F.col("region").isNotNull(), "hand").alias("source"), F.when(F.col("region").isNotNull(), "added").otherwise("outside").alias("change"))
    return known.select(*keys, "region", "probability", "source", "change").unionByName(fresh)
