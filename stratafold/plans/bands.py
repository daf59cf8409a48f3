"""The band between two labelled regions: two border lines fitted to the boundaries that face each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators import moments
from stratafold.operators import raster as ra
from stratafold.plans.regions import facing_boundary


def _normal(lines: DataFrame, towards: DataFrame, name: str) -> DataFrame:
    """A line's unit normal that points to ``towards``, and a point of the line."""
    ny, nx = -F.col("dx"), F.col("dy")
    side = F.when(ny * (F.col("ty") - F.col("cy")) + nx * (F.col("tx") - F.col("cx")) < 0, -1.0).otherwise(1.0)
    return lines.join(towards, "image").select("image", (ny * side).alias(f"{name}_ny"), (nx * side).alias(f"{name}_nx"))


def band_from_labels(framed: DataFrame, height: int, width: int, tilt: bool = False, first: int = 1, second: int = 2) -> DataFrame:
    """``image, normal_y, normal_x, ncm_offset, cmm_offset``, and with ``tilt`` ``cmm_normal_y, cmm_normal_x`` of the second border.

    Both borders share the normal of one line through both facing boundaries, every pixel counting once; with ``tilt`` each has its own. Normals
    point to the deepest pixel of the first region, offsets are from the middle of the image. All of it comes from sums of coordinates.
    An image without one of the regions, or with a boundary of fewer than two pixels, has no band.
    """
    own, other = F.col("lab") == first, F.col("lab") == second
    edge1 = facing_boundary(framed, own, other, height, width).select("image", "y", "x", F.lit(1).alias("side"))
    edge2 = facing_boundary(framed, other, own, height, width).select("image", "y", "x", F.lit(2).alias("side"))
    edges = edge1.unionByName(edge2)
    enough = edges.groupBy("image").agg(F.count(F.when(F.col("side") == 1, 1)).alias("a"), F.count(F.when(F.col("side") == 2, 1)).alias("b")).filter("a > 1 AND b > 1").select("image")
    edges = edges.join(enough, "image", "left_semi")
    deep = ra.edge_distance(framed, own).filter("d2 > 0").groupBy("image").agg(F.max_by(F.struct("y", "x"), F.struct(F.col("d2"), -F.col("y"), -F.col("x"))).alias("p"))
    towards = deep.select("image", F.col("p.y").alias("ty"), F.col("p.x").alias("tx"))
    lines = {side: moments.line_fit(edges.filter(F.col("side") == side), "image") for side in (1, 2)}
    if tilt:
        normals = _normal(lines[1], towards, "a").join(_normal(lines[2], towards, "b"), "image")
    else:
        shared = _normal(moments.line_fit(edges.select("image", "y", "x").distinct(), "image"), towards, "a")
        normals = shared.withColumn("b_ny", F.col("a_ny")).withColumn("b_nx", F.col("a_nx"))
    points = [lines[side].select("image", F.col("cy").alias(f"{n}_cy"), F.col("cx").alias(f"{n}_cx")) for side, n in ((1, "a"), (2, "b"))]
    whole = normals.join(points[0], "image").join(points[1], "image")
    offset = lambda n: F.col(f"{n}_ny") * (F.col(f"{n}_cy") - height / 2) + F.col(f"{n}_nx") * (F.col(f"{n}_cx") - width / 2)
    tilted = [F.col("b_ny").alias("cmm_normal_y"), F.col("b_nx").alias("cmm_normal_x")] if tilt else []
    return whole.select("image", F.col("a_ny").alias("normal_y"), F.col("a_nx").alias("normal_x"), offset("a").alias("ncm_offset"), offset("b").alias("cmm_offset"), *tilted)


def band_width(bands: DataFrame, scale_um: float) -> DataFrame:
    """``width_um`` of a band, negative where its borders have crossed."""
    return bands.withColumn("width_um", (F.col("ncm_offset") - F.col("cmm_offset")) * scale_um)
