"""Polygons: edges, area, even-odd membership by row spans, halving cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.ordered import next_in_ring
from stratafold.functions.sequential import filled_pixels, ring_masks
from stratafold.session import cut_lineage


def edges(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Edges ``(y1, x1) -> (y2, x2)`` of closed polygons ``(keys, vertex, y, x)``."""
    led = next_in_ring(vertices.select(*keys, "vertex", "y", "x"), keys, "vertex", ["y", "x"])
    return led.select(*keys, "vertex", F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("next_y").alias("y2"), F.col("next_x").alias("x2"))


def polygon_area(edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shoelace area; the sum is a partial aggregate, so a long polygon needs no gathering."""
    return edge_rows.groupBy(*keys).agg(
        (F.abs(F.sum(F.col("y1") * F.col("x2") - F.col("x1") * F.col("y2"))) / 2.0).alias("area"), F.count("*").alias("vertices"))


ROW_BAND = 32


def _sloped(edge_rows: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Edges that cross rows of the canvas, with the first and last row that they cross (half-open)."""
    low = F.greatest(F.ceil(F.least("y1", "y2")), F.lit(0))
    high = F.least(F.ceil(F.greatest("y1", "y2")) - 1, F.lit(height - 1))
    return edge_rows.filter(F.col("y1") != F.col("y2")).select(*keys, "y1", "x1", "y2", "x2", low.alias("_low"), high.alias("_high")).filter("_low <= _high")


def _flip_columns(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, y, c)``: pixels left of column ``c`` flip; one row per crossing of an edge and a row."""
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif((F.col("y2") - F.col("y1")).cast("double"), F.lit(0.0))
    return rows.select(*keys, "y", F.least(F.greatest(F.ceil(at), F.lit(0)), F.lit(width)).alias("c")).filter("c > 0")


def row_spans(edge_rows: DataFrame, keys: list[str], height: int, width: int, wanted: DataFrame | None = None) -> DataFrame:
    """Even-odd fill as half-open spans ``[x_from, x_to)`` per (polygon, row).

    An edge crosses row ``y`` when exactly one end is at or above it (half-open); every whole pixel left of the crossing
    flips. Crossings are counted per (polygon, row, column) before anything is ordered and even counts cancel, so the
    window that pairs them holds at most ``width + 1`` rows however many vertices the polygon has.

    ``wanted(scope.., y)`` limits the rows to those that are asked about: edges meet them by equality on bands of rows.
    """
    sloped = _sloped(edge_rows, keys, height)
    if wanted is None:
        rows = sloped.withColumn("y", F.explode(F.sequence("_low", "_high")))
    else:
        scope = [c for c in wanted.columns if c != "y"]
        asked = wanted.distinct().withColumn("_band", F.floor(F.col("y") / ROW_BAND))
        banded = sloped.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_low") / ROW_BAND), F.floor(F.col("_high") / ROW_BAND))))
        rows = banded.join(asked, [*scope, "_band"]).filter((F.col("y") >= F.col("_low")) & (F.col("y") <= F.col("_high")))
    flips = _flip_columns(rows, keys, width).groupBy(*keys, "y", "c").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    # Reading from the right: a pixel is inside when an odd number of flips lies beyond it.
    w = Window.partitionBy(*keys, "y").orderBy(F.col("c").desc())
    spans = flips.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead("c").over(w))
    return spans.filter("_rank % 2 = 1").select(*keys, F.col("y").cast("long").alias("y"), F.coalesce("_next", F.lit(0)).alias("x_from"), F.col("c").alias("x_to"))


def drawn_pixels(edge_rows: DataFrame, keys: list[str], height: int, width: int, most: int = 256) -> DataFrame:
    """``(keys, pixels)``: the pixels of ``row_spans`` of each closed polygon with whole coordinates, summed; polygons without any may be absent.

    Edges are counted first. A polygon of at most ``most`` edges is one row that holds them, and its rows of pixels are made and added up
    inside a task, so what is shuffled is edges. Larger ones go through ``row_spans``, which never gathers a polygon.
    """
    flat = edge_rows.filter("y1 <> y2 AND x1 IS NOT NULL AND x2 IS NOT NULL").select(*keys, F.array("y1", "x1", "y2", "x2").alias("_edge"))
    counted = flat.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys)
    small = flat.join(counted, keys, "left_anti").groupBy(*keys).agg(F.flatten(F.collect_list("_edge")).alias("_edges"))

    @F.pandas_udf("long")
    def filled(lists: pd.Series) -> pd.Series:
        return filled_pixels(lists, height, width)

    large = row_spans(edge_rows.join(counted, keys, "left_semi"), keys, height, width).groupBy(*keys).agg(F.sum(F.col("x_to") - F.col("x_from")).alias("pixels"))
    return small.select(*keys, filled("_edges").alias("pixels")).unionByName(large)


def points_in(points: DataFrame, spans: DataFrame, scope: list[str]) -> DataFrame:
    """Points at whole pixels joined to every polygon of the same scope that covers them.

    The equality part is (scope, row); inside it a row of one polygon has at most half its width in spans.
    """
    return points.join(spans, [*scope, "y"]).filter((F.col("x") >= F.col("x_from")) & (F.col("x") < F.col("x_to"))).drop("x_from", "x_to")


def points_inside(rows: DataFrame, keys: list[str], height: int, width: int, most: int = 256) -> DataFrame:
    """``(keys, y, x, vertices, a, b, inside)``: the distinct points of each polygon with the number of its distinct vertices, its first and last
    vertex and the even-odd rule; points without a polygon are left out.

    A row holds a ``corner(vertex, y, x)`` of the polygon, a ``point(y, x)`` that is asked about, or both; rows may repeat. They are counted
    first. A polygon of at most ``most`` rows is gathered into one, its points and edges are compared there, and its rows are what is
    shuffled. Larger ones meet their points by ``row_spans`` on the canvas and are never gathered.
    """
    known = rows.select(*keys, "corner", "point").dropna(subset=keys)
    large = cut_lineage(known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys))
    some_large = not large.isEmpty()
    small = known.join(large, keys, "left_anti") if some_large else known
    gathered = small.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_set("corner")).alias("_ring"), F.collect_set("point").alias("_points"))
    ring, size = F.col("_ring"), F.size("_ring")
    after = F.concat(F.slice(ring, 2, F.greatest(size - 1, F.lit(1))), F.slice(ring, 1, 1))
    asked = gathered.filter(size > 0).select(
        *keys, size.cast("long").alias("vertices"), F.get(F.filter(ring, lambda v: v["vertex"].isNotNull()), F.lit(0)).alias("a"), F.element_at(ring, -1).alias("b"),
        F.arrays_zip(ring.alias("p"), after.alias("q")).alias("_edges"), F.explode("_points").alias("_point"))
    y, x = F.col("_point.y"), F.col("_point.x")

    def crossed(edge: Column) -> Column:
        y1, x1, y2, x2 = edge["p"]["y"], edge["p"]["x"], edge["q"]["y"], edge["q"]["x"]
        return ((y1 <= y) != (y2 <= y)) & (x < x1 + (y - y1) * (x2 - x1) / F.nullif((y2 - y1).cast("double"), F.lit(0.0)))

    found = asked.select(*keys, y.alias("y"), x.alias("x"), "vertices", "a", "b", (F.size(F.filter("_edges", crossed)) % 2 == 1).alias("inside"))
    if not some_large:
        return found
    big = known.join(large, keys, "left_semi")
    corners = big.filter("corner IS NOT NULL").select(*keys, "corner.*").distinct()
    points = big.filter("point IS NOT NULL").select(*keys, "point.*").distinct()
    ends = F.struct("vertex", "y", "x")
    facts = corners.groupBy(*keys).agg(F.count("*").alias("vertices"), F.min_by(ends, "vertex").alias("a"), F.max_by(ends, "vertex").alias("b"))
    spans = row_spans(edges(corners, keys), keys, height, width, points.select(*keys, "y"))
    held = points_in(points, spans, keys).select(*keys, "y", "x").distinct().withColumn("_in", F.lit(True))
    return found.unionByName(points.join(facts, keys).join(held, [*keys, "y", "x"], "left").select(
        *keys, "y", "x", "vertices", "a", "b", F.coalesce("_in", F.lit(False)).alias("inside")))


MASK_WORDS = 8
MASK_BITS = 64 * MASK_WORDS


def _word(place: Column, j: int) -> Column:
    """The bit of a pixel in word ``j`` of its tile, 0 when it lies in another word."""
    word = F.shiftright(place.bitwiseAND(MASK_BITS - 1), 6)
    return F.when(word == j, _shifted(place)).otherwise(F.lit(0).cast("long"))


def _shifted(place: Column) -> Column:
    """The bit of a pixel in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def row_masks(edge_rows: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Even-odd fill as bitmaps: ``(keys, y, tile, inside)``, where ``inside`` is an array of ``MASK_WORDS`` longs whose bits are the pixels
    ``tile * MASK_BITS ..`` of the row. It covers the pixels of ``row_spans``.

    A crossing turns all pixels left of it, so a row of a polygon is the exclusive or of its crossings' masks: an aggregate of fixed size,
    combined before its only shuffle, however many vertices the polygon has.
    """
    rows = _sloped(edge_rows, keys, height).withColumn("y", F.explode(F.sequence("_low", "_high")))
    bit = (F.col("c") - 1).cast("long")  # the last pixel that turns
    flips = _flip_columns(rows, keys, width).select(*keys, F.col("y").cast("long").alias("y"), F.floor(bit / MASK_BITS).cast("int").alias("tile"),
                                                    bit.bitwiseAND(MASK_BITS - 1).alias("_bit"))
    words = [f"_w{j}" for j in range(MASK_WORDS)]
    everything = F.lit(-1).cast("long")
    turned = flips.groupBy(*keys, "y", "tile").agg(F.bit_xor(everything).alias("_all"), *[F.bit_xor(
        F.when(F.col("_bit") >= 64 * j, F.call_function("shiftrightunsigned", everything, F.greatest(F.lit(64 * j + 63) - F.col("_bit"), F.lit(0)).cast("int"))).otherwise(
            F.lit(0).cast("long"))).alias(w) for j, w in enumerate(words)])
    if width > MASK_BITS:  # a crossing turns all tiles left of its own as well, those without crossings too
        spread = turned.withColumn("_to", F.explode(F.sequence(F.lit(0), "tile")))
        turned = spread.groupBy(*keys, "y", F.col("_to").alias("tile")).agg(
            *[F.bit_xor(F.when(F.col("_to") == F.col("tile"), F.col(w)).otherwise(F.col("_all"))).alias(w) for w in words])
    return turned.filter(" OR ".join(f"{w} <> 0" for w in words)).select(*keys, "y", "tile", F.array(*words).alias("inside"))


def polygon_masks(vertices: DataFrame, keys: list[str], height: int, width: int, most: int = 256) -> DataFrame:
    """``row_masks`` of the closed polygons ``(keys, vertex, y, x)``, without shuffling the masks of those of at most ``most`` vertices.

    Vertices are counted first. A small polygon is one row that holds its ring, and its masks are made inside a task, so what is shuffled
    is vertices. Larger ones go through ``edges`` and ``row_masks``, which never gather a polygon.
    """
    corners = vertices.select(*keys, "vertex", "y", "x").dropna(subset=keys)
    large = cut_lineage(corners.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys))
    some_large = not large.isEmpty()
    small = corners.join(large, keys, "left_anti") if some_large else corners
    rings = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("vertex", "y", "x"))).alias("ring"))
    made = T.StructType([*[corners.schema[k] for k in keys], T.StructField("y", T.LongType()), T.StructField("tile", T.IntegerType()),
                         T.StructField("inside", T.ArrayType(T.LongType()))])

    def masked(batches):
        for batch in batches:
            yield from ring_masks(batch, keys, height, width, MASK_WORDS)

    masks = rings.mapInArrow(masked, made)
    return masks.unionByName(row_masks(edges(corners.join(large, keys, "left_semi"), keys), keys, height, width)) if some_large else masks


BROADCAST_ROWS = 100_000


def _met(masks: DataFrame, planes: DataFrame, scope: list[str]) -> DataFrame:
    """Masks with the bitmaps of their row. These are as many as the canvases have rows; they are made first, and the masks stay where they
    are while the bitmaps counted are few.
    """
    planes = cut_lineage(planes)
    return masks.join(F.broadcast(planes) if planes.count() <= BROADCAST_ROWS else planes, [*scope, "y", "tile"])


def pixels_in_masks(points: DataFrame, masks: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct whole pixels of ``points(scope.., y, x)`` with every polygon of the same scope that covers them, as ``points_in_masks`` has them.

    A row's pixels are one bitmap, so each mask meets one row; the bits common to both are the result.
    """
    words = [f"_p{j}" for j in range(MASK_WORDS)]
    tiled = points.select(*scope, "y", F.floor(F.col("x") / MASK_BITS).cast("int").alias("tile"), F.col("x").cast("long").alias("_x"))
    planes = tiled.groupBy(*scope, "y", "tile").agg(*[F.bit_or(_word(F.col("_x"), j)).alias(w) for j, w in enumerate(words)])
    common = F.array(*[F.get("inside", F.lit(j)).bitwiseAND(F.col(w)) for j, w in enumerate(words)])
    others = [c for c in masks.columns if c not in (*scope, "y", "tile", "inside")]
    bits = _met(masks, planes, scope).select(*scope, "y", *others, "tile", F.posexplode(common).alias("_word", "_bits")).filter("_bits <> 0")
    pixels = bits.select("*", F.explode(F.lit(list(range(64)))).alias("_bit")).filter(F.call_function("getbit", F.col("_bits"), F.col("_bit")) == 1)
    x = F.col("tile").cast("long") * MASK_BITS + F.col("_word") * 64 + F.col("_bit")
    return pixels.select(*scope, "y", x.cast(dict(points.dtypes)["x"]).alias("x"), *others)


def points_in_masks(points: DataFrame, masks: DataFrame, scope: list[str]) -> DataFrame:
    """Points at whole pixels joined to every polygon of the same scope that covers them: equality on (scope, row, tile), then one bit."""
    tiled = points.withColumn("tile", F.floor(F.col("x") / MASK_BITS).cast("int"))
    place = F.col("x").cast("long").bitwiseAND(MASK_BITS - 1)
    word = F.get("inside", F.shiftright(place, 6).cast("int"))
    return tiled.join(masks, [*scope, "y", "tile"]).filter(word.bitwiseAND(_shifted(place)) != 0).drop("tile", "inside")


def counts_in_masks(weights: DataFrame, masks: DataFrame, scope: list[str], key: str, weight: str = "n") -> DataFrame:
    """Summed weight of the whole-pixel points inside each polygon ``key``, without pairing points with polygons.

    A row's weights become bitmaps of their binary digits, one per digit that occurs; what a polygon has of a row is then the number of
    bits common to both, times the digit's value. ``weights(scope.., y, x, weight)`` holds each pixel once and no negative weight;
    the result is ``(key, weight)``, polygons without points left out.
    """
    words = [f"_p{j}" for j in range(MASK_WORDS)]
    n = F.col(weight).cast("long")
    digits = F.filter(F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int") + 1), lambda d: F.call_function("getbit", n, F.least(d, F.lit(63))) == 1)
    tiled = weights.filter(F.col(weight) > 0).select(*scope, "y", F.floor(F.col("x") / MASK_BITS).cast("int").alias("tile"), F.col("x").cast("long").alias("_x"),
                                                     F.explode(digits).alias("_digit"))
    planes = tiled.groupBy(*scope, "y", "tile", "_digit").agg(*[F.bit_or(_word(F.col("_x"), j)).alias(w) for j, w in enumerate(words)])
    common = sum((F.bit_count(F.get("inside", F.lit(j)).bitwiseAND(F.col(w))).cast("long") for j, w in enumerate(words)), F.lit(0).cast("long"))
    value = F.call_function("shiftleft", common, F.col("_digit"))
    return _met(masks, planes, scope).groupBy(key).agg(F.sum(value).alias(weight)).filter(F.col(weight) > 0)


def covered_by_masks(points: DataFrame, masks: DataFrame, scope: list[str], name: str = "covered") -> DataFrame:
    """Distinct whole-pixel points with whether any polygon covers them: the masks of a row are combined before they meet its points."""
    words = [F.bit_or(F.get("inside", F.lit(j))).alias(f"_w{j}") for j in range(MASK_WORDS)]
    merged = masks.groupBy(*scope, "y", "tile").agg(*words).select(*scope, "y", "tile", F.array(*[f"_w{j}" for j in range(MASK_WORDS)]).alias("inside"))
    place = F.col("x").cast("long").bitwiseAND(MASK_BITS - 1)
    word = F.get("inside", F.shiftright(place, 6).cast("int"))
    tiled = points.select(*scope, "y", "x").withColumn("tile", F.floor(F.col("x") / MASK_BITS).cast("int"))
    return tiled.join(merged, [*scope, "y", "tile"], "left").select(*scope, "y", "x", F.coalesce(word.bitwiseAND(_shifted(place)) != 0, F.lit(False)).alias(name))


def covered(points: DataFrame, spans: DataFrame, scope: list[str], name: str = "covered") -> DataFrame:
    """Distinct whole-pixel points with whether any span covers them, from changes of the cover along each row.

    Changes are summed per column first, so the window over a row holds at most a row of points and of changes.
    """
    changes = [spans.select(*scope, "y", F.col(c).cast("long").alias("x"), F.lit(s).alias("_change")) for c, s in (("x_from", 1), ("x_to", -1))]
    rows = changes[0].unionByName(changes[1]).unionByName(
        points.select(*scope, "y", F.col("x").cast("long").alias("x"), F.lit(0).alias("_change"), F.lit(True).alias("_point")), allowMissingColumns=True)
    summed = rows.groupBy(*scope, "y", "x").agg(F.sum("_change").alias("_change"), F.bool_or("_point").alias("_point"))
    along = Window.partitionBy(*scope, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summed.withColumn(name, F.sum("_change").over(along) > 0).filter("_point").select(*scope, "y", "x", name)


def covered_pixels(spans: DataFrame) -> DataFrame:
    """Spans as pixels."""
    return spans.withColumn("x", F.explode(F.sequence("x_from", F.col("x_to") - 1))).drop("x_from", "x_to")


def edge_lengths(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.withColumn("length", F.hypot(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))


def longest_edge(edge_rows: DataFrame, keys: list[str], ratio_required: float = 2.0) -> DataFrame:
    """Direction of the longest edge and how clearly it leads; ``clear`` is false when the runner-up is too long.

    The three longest of each polygon are ranked, which Spark cuts to three before the shuffle; the third only says that there are
    three edges at all. So the edges are made once.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.col("length").desc(), "vertex")
    top = edge_lengths(edge_rows).withColumn("_n", F.row_number().over(ranked)).filter("_n <= 3")
    joined = top.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 1, F.struct("vertex", "length", "y1", "x1", "y2", "x2"))).alias("b"),
        F.max(F.when(F.col("_n") == 2, F.col("length"))).alias("runner_up"), F.count("*").alias("edges")).filter("edges = 3")
    length = F.col("b.length")
    return joined.select(
        *keys, ((F.col("b.y2") - F.col("b.y1")) / F.nullif(length, F.lit(0.0))).alias("dir_y"),
        ((F.col("b.x2") - F.col("b.x1")) / F.nullif(length, F.lit(0.0))).alias("dir_x"), length.alias("longest"), "runner_up",
        (length / F.greatest("runner_up", F.lit(1e-9))).alias("ratio"), (length >= F.col("runner_up") * ratio_required).alias("clear"),
        F.col("b.y1").alias("y1"), F.col("b.x1").alias("x1"), F.col("b.y2").alias("y2"), F.col("b.x2").alias("x2"))


def half_plane(y: Column, x: Column, y0, x0, y1, x1, height: int, width: int) -> Column:
    """The side of a two-click cutoff line that holds the image centre."""
    ny, nx = x1 - x0, -(y1 - y0)
    side = ny * (y - y0) + nx * (x - x0)
    centre = ny * (F.lit(height / 2) - y0) + nx * (F.lit(width / 2) - x0)
    return F.when(centre > 0, side > 0).otherwise(side < 0)


def halving_axis(pixels: DataFrame, directions: DataFrame, marker: DataFrame, key: str) -> DataFrame:
    """Centroid, axis pointing at the marker, and the middle of the extent along it, per polygon.

    ``pixels(key, y, x)`` is the region, ``directions(key, dir_y, dir_x)`` its landmark edge, ``marker(key, y, x)`` one click.
    """
    middle = pixels.groupBy(key).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    turned = middle.join(directions.select(key, "dir_y", "dir_x"), key).join(
        marker.select(key, F.col("y").alias("my"), F.col("x").alias("mx")), key)
    toward = F.col("dir_y") * (F.col("my") - F.col("cy")) + F.col("dir_x") * (F.col("mx") - F.col("cx"))
    sign = F.when(toward < 0, -1.0).otherwise(1.0)
    axis = turned.select(key, "cy", "cx", (F.col("dir_y") * sign).alias("ay"), (F.col("dir_x") * sign).alias("ax"))
    reach = pixels.join(axis, key).groupBy(key).agg(
        F.min(projection()).alias("low"), F.max(projection()).alias("high"))
    return axis.join(reach, key).select(key, "cy", "cx", "ay", "ax", ((F.col("low") + F.col("high")) / 2).alias("midpoint"))


def projection() -> Column:
    return (F.col("y") - F.col("cy")) * F.col("ay") + (F.col("x") - F.col("cx")) * F.col("ax")


def split_halves(pixels: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """Each region pixel to its dorsal or ventral half."""
    return pixels.join(axis, key).select(
        key, "y", "x", F.when(projection() >= F.col("midpoint"), "dNCM").otherwise("vNCM").alias("half"))


def cut_segment(edge_rows: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """The part of the halving line spanned by the polygon: its two outermost crossings; absent when it misses."""
    joined = edge_rows.join(axis, key)
    here = (F.col("y1") - F.col("cy")) * F.col("ay") + (F.col("x1") - F.col("cx")) * F.col("ax") - F.col("midpoint")
    there = (F.col("y2") - F.col("cy")) * F.col("ay") + (F.col("x2") - F.col("cx")) * F.col("ax") - F.col("midpoint")
    crossed = joined.withColumn("_h", here).withColumn("_t", there).filter((F.col("_h") <= 0) != (F.col("_t") <= 0))
    share = F.col("_h") / F.nullif(F.col("_h") - F.col("_t"), F.lit(0.0))
    points = crossed.withColumn("py", F.col("y1") + share * (F.col("y2") - F.col("y1"))).withColumn(
        "px", F.col("x1") + share * (F.col("x2") - F.col("x1"))).withColumn("_along", F.col("px") * F.col("ay") - F.col("py") * F.col("ax"))
    ends = points.groupBy(key).agg(F.min_by(F.struct("py", "px"), "_along").alias("a"), F.max_by(F.struct("py", "px"), "_along").alias("b"),
                                   F.count("*").alias("crossings"))
    return ends.filter("crossings >= 2").select(
        key, F.col("a.py").alias("y1"), F.col("a.px").alias("x1"), F.col("b.py").alias("y2"), F.col("b.px").alias("x2"), "crossings")
