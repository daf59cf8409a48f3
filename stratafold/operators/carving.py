"""Carving of a region at black separations: half-planes along strips, then the piece on the centre's side.

The half-planes of an image are one bounded array, as many as it has strips of the least length, so a region's pixel meets its image's array
once and is tested inside the task; pixels are never paired with strips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.components import components, fill_holes, piece_nearest, sizes
from stratafold.operators.moments import whole_moments

PIXEL = ["image", "y", "x"]
_CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def touching(barrier: DataFrame, region: DataFrame) -> DataFrame:
    """Pixels of the barrier in the region or beside it."""
    near = region.select("image", F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in _CROSS])).alias("p"))
    return barrier.select(*PIXEL).join(near.select("image", "p.y", "p.x").distinct(), PIXEL, "left_semi")


def half_planes(strips: DataFrame, centre: DataFrame, least: float, keep: float) -> DataFrame:
    """Per image an array of half-planes that hold its centre: ``ny * y + nx * x >= floor``.

    Each piece at least ``least`` pixels long gives one, along its long axis; a line nearer to the centre than ``keep`` is moved away to
    that distance. ``centre``: ``image, cy, cx``. A centre on the line cuts nothing.
    """
    pieces = components(strips)
    box = sizes(pieces).filter(F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")) + 1 >= least).select("image", "component")
    m = whole_moments(pieces.join(box, ["image", "component"]), "image", "component")
    angle = F.atan2(2 * F.col("vyx"), F.col("vx") - F.col("vy")) * 0.5
    lines = m.select("image", "ay", "ax", (-F.cos(angle)).alias("ny"), F.sin(angle).alias("nx")).join(centre, "image")
    lines = lines.withColumn("off", F.col("ny") * (F.col("cy") - F.col("ay")) + F.col("nx") * (F.col("cx") - F.col("ax")))
    floor = F.least(F.lit(0.0), F.abs("off") - keep).alias("floor")
    return lines.select("image", "ny", "nx", "ay", "ax", F.signum("off").alias("sign"), floor).groupBy("image").agg(
        F.collect_list(F.struct("ny", "nx", "ay", "ax", "sign", "floor")).alias("planes"))


def cut_by_planes(region: DataFrame, planes: DataFrame) -> DataFrame:
    """The pixels that lie in all half-planes of their image."""
    def inside(p):
        return (p["ny"] * (F.col("y") - p["ay"]) + p["nx"] * (F.col("x") - p["ax"])) * p["sign"] >= p["floor"]

    return region.select(*PIXEL).join(planes, "image", "left").filter(F.col("planes").isNull() | F.forall("planes", inside)).select(*PIXEL)


def stop_at(region: DataFrame, barrier: DataFrame, centre: DataFrame, frame: DataFrame, height: int, width: int) -> DataFrame:
    """The piece of the region off the barrier that is nearest to the centre, its holes filled; a region all on the barrier stays."""
    allowed = region.select(*PIXEL).join(barrier.select(*PIXEL).distinct(), PIXEL, "left_anti")
    away = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    kept = piece_nearest(allowed, away, centre)
    whole = region.select(*PIXEL).join(allowed.select("image").distinct(), "image", "left_anti")
    images = frame.join(allowed.select("image").distinct(), "image", "left_semi")
    return fill_holes(kept, images, height, width).unionByName(whole)


def carve(region: DataFrame, barrier: DataFrame, centre: DataFrame, frame: DataFrame, height: int, width: int, least: float, keep: float) -> DataFrame:
    """Half-planes along the strips that reach into the region first, then the centre's side of the barrier; holes last."""
    planes = half_planes(touching(barrier, region), centre, least, keep)
    return stop_at(cut_by_planes(region, planes), barrier, centre, frame, height, width)


def barrier_floor(pixels: DataFrame, dark: str, scale: float, least: float) -> DataFrame:
    """Per image the length that strips of a cue need: ``scale`` for each percent of its pixels that is dark, ``least`` at the least."""
    share = F.avg(F.col(dark).cast("double"))
    return pixels.groupBy("image").agg(F.greatest(scale * 100 * share, F.lit(float(least))).alias("floor"))


def scaled_barrier(pixels: DataFrame, cues: dict[str, tuple[float, float]], reach: int, height: int, width: int) -> DataFrame:
    """Wide gaps of every dark cue and its thin strips that are long enough for the image: ``cues`` maps a boolean column to the scale and the
    least of its ``barrier_floor``."""
    from stratafold.operators import raster as ra

    found = None
    for cue, (scale, least) in cues.items():
        wide = ra.wide_gaps(pixels, cue, reach, height, width, "_gap").filter("_gap").select(*PIXEL)
        pieces = components(ra.long_strips(pixels, cue, reach, 1.0, height, width))
        box = sizes(pieces).join(barrier_floor(pixels, cue, scale, least), "image").filter(
            F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")) + 1 >= F.col("floor"))
        both = wide.unionByName(pieces.join(box.select("image", "component"), ["image", "component"]).select(*PIXEL))
        found = both if found is None else found.unionByName(both)
    return found.distinct()
