"""Straight-edged shapes of a region in the band frame, on either side of the band.

``sign`` is 1 for the region in front of the band and -1 for the one behind it. Measuring uses one mirrored coordinate, ``sign * across``,
which grows into the region on both sides, so both share all formulas; ends and slopes are given in the frame again, slopes per micrometre
of ``across``. A region's line is the middle of its side that faces the band, its depth is counted from there. Every step is an aggregate
by image with partial sums, or a filter; what is joined to pixels is one row an image, checkpointed where several steps need it, so that
pixels are read three times for a measurement and twice for a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.scalars import fan
from stratafold.operators import components as cc
from stratafold.operators.frames import BIN_UM, inside_polygon, projections
from stratafold.plans.fits import SIDE_MIN_PX, leash
from stratafold.session import cut_lineage

RELATIVE = ("f_low", "f_high", "f_depth")


def tissue_extent(framed: DataFrame) -> DataFrame:
    """``image, extent``: how far tissue runs across the band; 1 without tissue."""
    across = F.when(F.col("tissue"), F.col("across"))
    return framed.groupBy("image").agg(F.coalesce(F.max(across) - F.min(across), F.lit(1.0)).alias("extent"))


def measures(framed: DataFrame, region: Column, sign: int, thickness_um: float, bin_um: float = BIN_UM) -> DataFrame:
    """``image, line, gap, share, depth, low, high, slope_low, slope_high`` of a region; no row for one of fewer than three slices.

    ``line``: ``across`` of the side's middle, the median over bins of ``along`` of the outermost pixel; of fewer than three bins, the
    outermost pixel of all. ``gap``: from the band's edge on this side to the line. ``share``: behind the band, the line's distance as a
    share of the tissue's extent. Ends are lines through the lowest and highest ``along`` of slices, at the region's line. Bins and slices
    of fewer than twenty pixels do not count.
    """
    grown, own = F.when(region, sign * F.col("across")), F.when(region, F.col("along"))
    tissue = F.when(F.col("tissue"), F.col("across"))
    edge = cut_lineage(framed.groupBy("image").agg(
        F.min(grown).alias("_first"), F.max(grown).alias("_last"), F.min(own).alias("_start"), F.max(own).alias("_stop"),
        F.coalesce(F.max(tissue) - F.min(tissue), F.lit(1.0)).alias("extent")).filter("_first IS NOT NULL"))
    placed = framed.filter(region).select("image", "along", (sign * F.col("across")).alias("_in")).join(edge, "image")
    column, slice_ = F.floor((F.col("along") - F.col("_start")) / bin_um), F.floor((F.col("_in") - F.col("_first")) / bin_um)
    side = placed.groupBy("image", column.alias("_b")).agg(F.count("*").alias("_n"), F.min("_in").alias("_e"), F.first(F.col("_stop") - F.col("_start")).alias("_w"))
    side = side.filter((F.col("_n") >= SIDE_MIN_PX) & (F.col("_b") * bin_um < F.col("_w"))).groupBy("image").agg(
        F.count("*").alias("_bins"), F.percentile("_e", 0.5).alias("_middle")).filter("_bins >= 3").select("image", "_middle")
    facts = cut_lineage(edge.join(side, "image", "left").withColumn("_line", F.coalesce("_middle", "_first")))
    slices = placed.groupBy("image", slice_.alias("_s")).agg(F.count("*").alias("_n"), F.min("along").alias("_low"), F.max("along").alias("_high"))
    slices = slices.filter(F.col("_n") >= SIDE_MIN_PX).join(facts, "image").filter(F.col("_s") * bin_um < F.col("_last") - F.col("_first")).withColumn(
        "_at", F.col("_s") * bin_um + bin_um / 2 + F.col("_first") - F.col("_line"))
    ends = slices.groupBy("image").agg(
        F.count("*").alias("_slices"), F.regr_intercept("_low", "_at").alias("low"), F.regr_intercept("_high", "_at").alias("high"),
        (sign * F.regr_slope("_low", "_at")).alias("slope_low"), (sign * F.regr_slope("_high", "_at")).alias("slope_high")).filter("_slices >= 3")
    behind = F.lit(sign < 0)
    return facts.join(ends, "image").select(
        "image", (sign * F.col("_line")).alias("line"), (F.col("_line") - F.when(behind, thickness_um).otherwise(0.0)).alias("gap"),
        F.when(behind, F.col("_line") / F.col("extent")).alias("share"), (F.col("_last") - F.col("_line")).alias("depth"),
        "low", "high", "slope_low", "slope_high")


def near_line(framed: DataFrame, constants: DataFrame, sign: int, thickness_um: float) -> DataFrame:
    """``constants(image, gap, share, ..)`` with ``near``, where the line goes.

    In front of the band it lies ``gap`` from the band's edge; behind it, ``share`` of the tissue's extent away or, where no share
    was fitted, ``gap`` beyond the far edge.
    """
    if sign > 0:
        return constants.withColumn("near", F.col("gap"))
    near = F.coalesce(-F.col("share") * F.col("extent"), -F.col("gap") - thickness_um)
    return constants.join(tissue_extent(framed), "image").withColumn("near", near).drop("extent")


def tissue_span(framed: DataFrame, lines: DataFrame, sign: int, slab_um: float = 200.0, reach_um: float = 4000.0) -> DataFrame:
    """``image, span_low, span_high, span_depth`` of the tissue behind ``lines(image, near)``; no row without tissue there.

    The ends are those of the slab next to the line; the depth is that of the span's middle half, since tissue curves away at its ends.
    """
    past = sign * (F.col("across") - F.col("near"))
    behind = framed.filter("tissue").join(lines.select("image", "near"), "image").select("image", "along", past.alias("_past")).filter(F.col("_past").between(0.0, reach_um))
    ends = cut_lineage(behind.filter(F.col("_past") <= slab_um).groupBy("image").agg(F.min("along").alias("span_low"), F.max("along").alias("span_high")))
    low, high = F.col("span_low"), F.col("span_high")
    middle = behind.join(ends, "image").filter(F.abs(F.col("along") - (low + high) / 2) <= (high - low) / 4)
    return ends.join(middle.groupBy("image").agg(F.max("_past").alias("span_depth")), "image")


def relative_measures(framed: DataFrame, measured: DataFrame, sign: int, slab_um: float = 200.0, reach_um: float = 4000.0) -> DataFrame:
    """``measures`` with ``f_low, f_high, f_depth``: ends and depth as fractions of the tissue's span at the region's own line."""
    measured = cut_lineage(measured)
    span = tissue_span(framed, measured.select("image", F.col("line").alias("near")), sign, slab_um, reach_um)
    width = F.greatest(F.col("span_high") - F.col("span_low"), F.lit(1.0))
    return measured.join(span, "image").select(
        *measured.columns, ((F.col("low") - F.col("span_low")) / width).alias("f_low"), ((F.col("high") - F.col("span_low")) / width).alias("f_high"),
        (F.col("depth") / F.greatest("span_depth", F.lit(1.0))).alias("f_depth"))


def sized_by_tissue(framed: DataFrame, constants: DataFrame, sign: int, slab_um: float = 200.0, reach_um: float = 4000.0) -> DataFrame:
    """``constants(image, near, f_low, f_high, f_depth, ..)`` with ``low, high, depth`` from this image's tissue; images without any behind the line go."""
    width = F.col("span_high") - F.col("span_low")
    sized = {"low": F.col("span_low") + F.col("f_low") * width, "high": F.col("span_low") + F.col("f_high") * width, "depth": F.col("f_depth") * F.col("span_depth")}
    kept = [c for c in constants.columns if c not in (*RELATIVE, *sized)]
    return constants.join(tissue_span(framed, constants, sign, slab_um, reach_um), "image").select(*kept, *[v.alias(n) for n, v in sized.items()])


def marched_end(framed: DataFrame, lines: DataFrame, dark: Column, slab_um: float = 40.0, step_um: float = 20.0, reach_um: float = 2600.0,
                black: float = 0.15, tissue: float = 0.5, least_px: int = 200) -> DataFrame:
    """``image, stop``: how far the line runs from its middle towards high ``along`` before black or the tissue's end.

    Pixels within ``slab_um`` of ``lines(image, near)`` are counted in steps of ``along``; a step is good when tissue has at least and black
    less than its share. No row where the strip is thin or its middle is off tissue.
    """
    strip = framed.join(lines.select("image", "near"), "image").filter(F.abs(F.col("across") - F.col("near")) <= slab_um)
    last = int(reach_um // step_um)
    steps = strip.groupBy("image", F.floor(F.col("along") / step_um).alias("_step")).agg(
        F.count("*").alias("_n"), F.avg(F.col("tissue").cast("double")).alias("_t"), F.avg(dark.cast("double")).alias("_d"))
    whole = steps.groupBy("image").agg(F.sum("_n").alias("_all"), F.max(F.when(F.col("_step") == 0, F.col("_t"))).alias("_middle")).filter(
        (F.col("_all") >= least_px) & (F.col("_middle") >= tissue))
    good = steps.filter(F.col("_step").between(1, last) & (F.col("_t") >= tissue) & (F.col("_d") < black))
    # the steps that follow the middle without a break are those whose number is their rank; ``reach_um`` bounds them
    ranked = good.withColumn("_rank", F.row_number().over(Window.partitionBy("image").orderBy("_step"))).filter("_step = _rank")
    reached = ranked.groupBy("image").agg(F.max("_step").alias("_far"))
    return whole.join(reached, "image", "left").select("image", (F.coalesce("_far", F.lit(0)) * step_um).cast("double").alias("stop"))


def with_marched_high(constants: DataFrame, stops: DataFrame) -> DataFrame:
    """``constants(.., high, high_offset)`` with ``high`` halfway to the march's stop less its fitted overshoot, where both are known."""
    pulled = (F.col("stop") - F.col("high_offset") + F.col("high")) / 2
    return constants.join(stops.select("image", "stop"), "image", "left").withColumn("high", F.coalesce(pulled, "high")).drop("stop")


def grown_from_line(region: DataFrame, framed: DataFrame, barrier: DataFrame, lines: DataFrame, height: int, width: int, seed_um: float = 120.0) -> DataFrame:
    """The pieces of a region, cut at a barrier, that come within ``seed_um`` of their line; holes are filled last.

    Without such a piece the largest stays; a region that the barrier covers whole stays as it is.
    """
    pixel = ["image", "y", "x"]
    allowed = region.select(*pixel).join(barrier.select(*pixel), pixel, "left_anti")
    seeds = framed.join(lines.select("image", "near"), "image").filter(F.abs(F.col("across") - F.col("near")) <= seed_um).select(*pixel)
    grown = cc.fill_holes(cc.pieces_touching(allowed, seeds), framed, height, width)
    covered = region.select(*pixel).join(allowed.select("image").distinct(), "image", "left_anti")
    return grown.unionByName(covered)


def slid_onto_line(offsets: DataFrame, framed: DataFrame, lines: DataFrame, sign: int, leash_um: float | None = None, directions: int = 16) -> DataFrame:
    """Half-planes ``(image, k, offset)`` moved across the band until the polygon's side lies on ``lines(image, near)``.

    The polygon is taken unclipped, for tissue may cut its side away; one without pixels, or without a line, stays where it is. A move adds
    to every offset what its direction has of ``across``.
    """
    whole = offsets.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "offset"))), lambda z: z.offset).alias("_o"))  # one entry per direction
    inside = framed.join(whole, "image").filter(inside_polygon(projections(F.col("along"), F.col("across"), directions), F.col("_o")))
    side = inside.groupBy("image").agg((sign * F.min(sign * F.col("across"))).alias("_here"))
    moves = side.join(lines.select("image", "near"), "image")
    move = F.col("near") - F.col("_here") if leash_um is None else leash(F.lit(0.0), F.col("near") - F.col("_here"), leash_um)
    part = F.element_at(F.array(*[F.lit(float(dx)) for _, _, dx in fan(directions)]), F.col("k").cast("int") + 1)
    return offsets.join(moves.select("image", move.alias("_move")), "image", "left").select(
        "image", "k", (F.col("offset") + part * F.coalesce("_move", F.lit(0.0))).alias("offset"))


def cut_at_line(region: DataFrame, lines: DataFrame, sign: int) -> DataFrame:
    """The pixels ``(image, y, x, across)`` on the region's side of ``lines(image, near)``, the line included."""
    return region.join(lines.select("image", "near"), "image").filter(sign * (F.col("across") - F.col("near")) >= 0).select(*region.columns)
