"""Coordinates of pixels relative to a section's band, and regular grids over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import CANVAS_UM
from stratafold.functions.scalars import fan

# Extent of the voting grid in micrometres and the width of its bins.
BIN_UM = 100.0
ALONG_LIMIT_UM = 3000.0
ACROSS_LOW_UM = -4000.0
ACROSS_HIGH_UM = 3000.0


def signed_distance(ny: Column, nx: Column, height: int, width: int) -> Column:
    """Distance of a pixel from the image centre along a unit normal."""
    return ny * (F.col("y") - height / 2) + nx * (F.col("x") - width / 2)


def band_frame(pixels: DataFrame, bands: DataFrame, height: int, width: int) -> DataFrame:
    """``along`` and ``across`` in micrometres; 0 across is the near border, left hemispheres are mirrored.

    One band row per image meets its pixels on the image key; whether that row is broadcast is left to its measured size.
    """
    joined = pixels.join(bands, "image")
    ny, nx = F.col("normal_y"), F.col("normal_x")
    along = (signed_distance(-nx, ny, height, width) - (F.col("span_low") + F.col("span_high")) / 2) * CANVAS_UM
    across = (signed_distance(ny, nx, height, width) - F.col("ncm_offset")) * CANVAS_UM
    return joined.withColumn("along", F.when(F.col("mirror"), -along).otherwise(along)).withColumn("across", across)


def in_atlas(along: Column, across: Column) -> Column:
    return (F.abs(along) < ALONG_LIMIT_UM) & (across > ACROSS_LOW_UM) & (across < ACROSS_HIGH_UM)


def bin_index(along: Column, across: Column, bin_um: float = BIN_UM) -> Column:
    """Flat number of the grid bin, clipped to the grid."""
    columns = int(2 * ALONG_LIMIT_UM / bin_um)
    rows = int((ACROSS_HIGH_UM - ACROSS_LOW_UM) / bin_um)

    def clip(value, top):
        return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(top))

    return clip((along + ALONG_LIMIT_UM) / bin_um, columns - 1) * rows + clip((across - ACROSS_LOW_UM) / bin_um, rows - 1)


def projections(along: Column, across: Column, directions: int = 16) -> Column:
    """Array of the pixel's distance along each fanned direction."""
    return F.array(*[F.lit(dy) * along + F.lit(dx) * across for _, dy, dx in fan(directions)])


def inside_polygon(projected: Column, offsets: Column) -> Column:
    """Convex region: every projection at most its offset (two arrays of equal length)."""
    return F.forall(F.arrays_zip(projected.alias("p"), offsets.alias("o")), lambda z: z.p <= z.o)


def grid(frame: DataFrame, key: str, rows: int, columns: int) -> DataFrame:
    """Every cell of a regular grid per key."""
    return frame.select(key).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))


def canonical_cell(along: Column, across: Column, high_um: float, half_um: float, cell_um: float) -> tuple[Column, Column]:
    """Row and column of the canonical frame whose cell holds a pixel; rows run down from the far border."""
    row = F.rint((F.lit(high_um) - across) / cell_um - 0.5).cast("long")
    return row, F.rint((along + half_um) / cell_um - 0.5).cast("long")


def unwarp(mask: DataFrame, framed: DataFrame, high_um: float, half_um: float, cell_um: float) -> DataFrame:
    """A mask ``(image, row, column)`` of the canonical frame on the section's pixels, as ``inside``.

    Each pixel asks for its own cell, so a frame coarser than the section leaves no holes; pixels off the frame are outside.
    """
    row, column = canonical_cell(F.col("along"), F.col("across"), high_um, half_um, cell_um)
    cells = mask.select("image", F.col("row").cast("long").alias("_row"), F.col("column").cast("long").alias("_column")).distinct().withColumn("_in", F.lit(True))
    found = framed.withColumn("_row", row).withColumn("_column", column).join(cells, ["image", "_row", "_column"], "left")
    return found.withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_row", "_column", "_in")
