"""Connected pieces of pixel masks ``(image, y, x)`` and what is decided by them.

Pieces are found inside tiles first (a tile is a bounded group), then pieces that touch across tile borders are merged as a
graph. That graph has one node per piece and tile, so it is far smaller than the raster; it is solved by alternating
large-star and small-star rounds, whose state is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.sequential import tile_components
from stratafold.operators.moments import whole_moments
from stratafold.session import cut_lineage

TILE = 512


def _tile(axis: str, tile: int) -> Column:
    return F.floor(F.col(axis) / tile)


def _signature(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("image", "a", "b").cast("decimal(38,0)")).alias("h")).first()


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("image", "a", "b").unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it; the minimum is a mergeable aggregate."""
    both = _symmetric(edges)
    low = both.groupBy("image", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, ["image", "a"]).select("image", F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select("image", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("image", "a").agg(F.min("b").alias("m"))
    tied = down.join(low, ["image", "a"])
    return tied.select("image", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        tied.select("image", "a", F.col("m").alias("b"))).filter("a <> b").distinct()


def star_roots(edges: DataFrame) -> DataFrame:
    """``(image, a, b)``: every node of the graph with the smallest node of its piece; rounds grow with the logarithm of its size."""
    now = cut_lineage(edges.filter("a <> b").select("image", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    mark = _signature(now)
    while mark != before:
        now = cut_lineage(_small_star(_large_star(now)))
        before, mark = mark, _signature(now)
    return now


def components(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image, y, x, component)``: the 4-connected piece of each pixel, named by the code of its first pixel in raster order."""
    pixels = mask.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    local = cut_lineage(pixels.groupBy("image", _tile("y", tile), _tile("x", tile)).applyInPandas(
        tile_components, "image long, y long, x long, local long"))
    seams = []
    for axis, other in (("y", "x"), ("x", "y")):
        first = local.filter(F.col(axis) % tile == 0).select("image", (F.col(axis) - 1).alias(axis), other, F.col("local").alias("a"))
        last = local.filter(F.col(axis) % tile == tile - 1).select("image", axis, other, F.col("local").alias("b"))
        seams.append(first.join(last, ["image", axis, other]).select("image", "a", "b"))
    edges = seams[0].unionByName(seams[1]).distinct()
    if edges.isEmpty():
        return local.withColumnRenamed("local", "component")
    roots = star_roots(edges).select("image", F.col("a").alias("local"), F.col("b").alias("_root"))
    return local.join(roots, ["image", "local"], "left").select("image", "y", "x", F.coalesce("_root", "local").alias("component"))


def sizes(pieces: DataFrame) -> DataFrame:
    """Pixels and bounding box of every piece."""
    return pieces.groupBy("image", "component").agg(
        F.count("*").alias("pixels"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left"), F.max("x").alias("right"))


def keep_pieces(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pixels of the chosen ``(image, component)``."""
    return pieces.join(chosen.select("image", "component").distinct(), ["image", "component"], "left_semi").select("image", "y", "x")


def largest_piece(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """The biggest piece of each image; ties go to the first in raster order."""
    pieces = components(mask, tile)
    best = pieces.groupBy("image", "component").agg(F.count("*").alias("n")).groupBy("image").agg(
        F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("component"))
    return keep_pieces(pieces, best)


def pieces_touching(mask: DataFrame, seeds: DataFrame, fall_back: bool = True, tile: int = TILE) -> DataFrame:
    """Pieces that contain a seed pixel; with ``fall_back`` an image whose seeds touch nothing keeps its largest piece."""
    pieces = components(mask, tile)
    hit = pieces.join(seeds.select("image", "y", "x").distinct(), ["image", "y", "x"]).select("image", "component").distinct()
    if not fall_back:
        return keep_pieces(pieces, hit)
    best = pieces.groupBy("image", "component").agg(F.count("*").alias("n")).groupBy("image").agg(
        F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("component"))
    return keep_pieces(pieces, hit.unionByName(best.join(hit.select("image"), "image", "left_anti")))


def piece_nearest(mask: DataFrame, scored: Column, extra: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """The piece of the pixel with the smallest score per image, first in raster order on ties."""
    pieces = components(mask, tile)
    rated = pieces if extra is None else pieces.join(extra, "image")
    best = rated.groupBy("image").agg(F.min_by("component", F.struct(scored, F.col("y"), F.col("x"))).alias("component"))
    return keep_pieces(pieces, best)


def holes(mask: DataFrame, frame: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Pieces of the complement that do not touch the image's frame, with their size: ``(image, y, x, component, pixels)``."""
    outside = frame.select("image", "y", "x").join(mask.select("image", "y", "x"), ["image", "y", "x"], "left_anti")
    pieces = components(outside, tile)
    facts = sizes(pieces).filter((F.col("top") > 0) & (F.col("left") > 0) & (F.col("bottom") < height - 1) & (F.col("right") < width - 1))
    return pieces.join(facts.select("image", "component", "pixels"), ["image", "component"])


def fill_holes(mask: DataFrame, frame: DataFrame, height: int, width: int, share: float | None = None, tile: int = TILE) -> DataFrame:
    """The mask with its enclosed holes added; with ``share`` only holes up to that share of the mask's area."""
    found = holes(mask, frame, height, width, tile)
    if share is not None:
        area = mask.groupBy("image").agg(F.count("*").alias("_area"))
        found = found.join(area, "image").filter(F.col("pixels") <= share * F.col("_area"))
    return mask.select("image", "y", "x").unionByName(found.select("image", "y", "x"))


def reachable(region: DataFrame, black: DataFrame, seeds: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """The part of a region joined to its seed pixels without crossing black that opens onto the frame.

    Images whose seeds are not in the remaining region keep what remains.
    """
    pieces = components(black, tile)
    outer = sizes(pieces).filter((F.col("top") == 0) | (F.col("left") == 0) | (F.col("bottom") == height - 1) | (F.col("right") == width - 1))
    kept = region.select("image", "y", "x").join(keep_pieces(pieces, outer), ["image", "y", "x"], "left_anti")
    parts = components(kept, tile)
    hit = parts.join(seeds.select("image", "y", "x").distinct(), ["image", "y", "x"]).select("image", "component").distinct()
    whole = parts.join(hit.select("image").distinct(), "image", "left_anti").select("image", "y", "x")
    return keep_pieces(parts, hit).unionByName(whole)


def cut_at_strips(region: DataFrame, strips: DataFrame, centre: DataFrame, least: int, keep: float, tile: int = TILE) -> DataFrame:
    """Keep the centre's side of the line through every strip piece at least ``least`` pixels long, at least ``keep`` off the centre."""
    pieces = components(strips, tile)
    box = sizes(pieces).filter(F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")) + 1 >= least)
    m = whole_moments(pieces.join(box.select("image", "component"), ["image", "component"]), "image", "component")
    angle = F.atan2(2 * F.col("vyx"), F.col("vx") - F.col("vy")) * 0.5
    lines = m.select("image", "ay", "ax", (-F.cos(angle)).alias("ny"), F.sin(angle).alias("nx")).join(centre, "image")
    offset = F.col("ny") * (F.col("cy") - F.col("ay")) + F.col("nx") * (F.col("cx") - F.col("ax"))
    lines = lines.withColumn("off", offset)
    signed = (F.col("ny") * (F.col("y") - F.col("ay")) + F.col("nx") * (F.col("x") - F.col("ax"))) * F.signum("off")
    floor = F.least(F.lit(0.0), F.abs("off") - keep)
    cut = region.select("image", "y", "x").join(lines, "image").filter(~(signed >= floor)).select("image", "y", "x").distinct()
    return region.select("image", "y", "x").join(cut, ["image", "y", "x"], "left_anti")
