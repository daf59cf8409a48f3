"""One-dimensional profiles along a band: ``(image, bin, position, value)``; a null value means no tissue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.constants import ALONG_BIN_UM


def along_profile(pixels: DataFrame, value: Column) -> DataFrame:
    """Mean value per bin along the band, every bin between the first and the last."""
    made = pixels.groupBy("image", F.rint(F.col("along") / ALONG_BIN_UM).cast("long").alias("bin")).agg(F.avg(value).alias("value"))
    ends = made.groupBy("image").agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    grid = ends.select("image", F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    return grid.join(made, ["image", "bin"], "left").withColumn("position", F.col("bin") * ALONG_BIN_UM)


def _line():
    return Window.partitionBy("image").orderBy("bin")


def _whole():
    return Window.partitionBy("image")


def departure(profile: DataFrame, half_um: float, missing: float = 1.0) -> DataFrame:
    """Adds ``departure``: distance of the colour from the median of the band's middle; no tissue counts as ``missing``."""
    reference = F.percentile(F.when(F.abs("position") <= half_um, F.col("value")), 0.5).over(_whole())
    made = profile.withColumn("_ref", reference).filter("_ref > 0")
    return made.withColumn("departure", F.coalesce(F.abs(F.col("value") / F.col("_ref") - 1.0), F.lit(missing))).drop("_ref")


def dip_depth(profile: DataFrame, reach: int) -> DataFrame:
    """Adds ``depth``: how much darker than the brightest tissue within ``reach`` bins on both sides; null where unknown."""
    before, after = F.max("value").over(_line().rowsBetween(-reach, -1)), F.max("value").over(_line().rowsBetween(1, reach))
    shoulder = F.when(before.isNotNull() & after.isNotNull(), F.least(before, after))
    made = profile.withColumn("_s", shoulder)
    return made.withColumn("depth", F.when(F.col("_s") > 0, 1.0 - F.col("value") / F.col("_s"))).drop("_s")


def two_sides(profile: DataFrame) -> DataFrame:
    """Each side of the centre in scan order outwards: ``side`` -1 or 1, ``ord`` from 0. The centre bin starts both sides."""
    centre = F.min_by("bin", F.struct(F.abs("position"), F.col("bin"))).over(_whole())
    marked = profile.withColumn("_c", centre)
    sides = F.array_compact(F.array(F.when(F.col("bin") <= F.col("_c"), F.lit(-1)), F.when(F.col("bin") >= F.col("_c"), F.lit(1))))
    return marked.withColumn("side", F.explode(sides)).withColumn("ord", F.abs(F.col("bin") - F.col("_c"))).drop("_c")


def contiguous(sides: DataFrame) -> DataFrame:
    """Rows of each side up to the first gap after tissue; adds ``edge``, the position of the last tissue bin before it."""
    scan = Window.partitionBy("image", "side").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    tissue = F.col("value").isNotNull()
    made = sides.withColumn("_seen", F.bool_or(tissue).over(scan)).withColumn("_broke", F.bool_or(F.col("_seen") & ~tissue).over(scan))
    kept = made.filter(~F.col("_broke") & tissue)
    side = Window.partitionBy("image", "side")
    return kept.withColumn("edge", F.max_by("position", "ord").over(side)).drop("_seen", "_broke")


def candidates(profile: DataFrame, reach: int, guard_um: float | None = None) -> DataFrame:
    """Dips of each side with a known depth, and every side's edge; ``usable`` drops dips closer than the guard to the edge."""
    rows = contiguous(two_sides(dip_depth(profile, reach)))
    ok = F.col("depth").isNotNull()
    if guard_um is not None:
        ok = ok & (F.abs(F.col("position") - F.col("edge")) > guard_um)
    return rows.withColumn("usable", ok)


def deepest(cands: DataFrame, extra: Column | None = None) -> DataFrame:
    """Per side: the position of the deepest usable dip, first in scan order on ties; null when there is none."""
    ok = F.col("usable") if extra is None else F.col("usable") & extra
    best = F.max_by(F.when(ok, F.col("position")), F.when(ok, F.struct(F.col("depth"), -F.col("ord"))))
    return cands.groupBy("image", "side").agg(best.alias("stop"), F.first("edge").alias("edge"))


def dip_stop(cands: DataFrame, floor_um: float | None = None, floor_share: float | None = None, min_depth: float | None = None,
             else_edge: bool = False) -> DataFrame:
    """Single-side stops: the deepest dip past a floor, at least so deep; optionally the tissue edge when none qualifies."""
    keep = F.lit(True)
    if floor_um is not None:
        keep = keep & (F.abs("position") >= floor_um)
    if floor_share is not None:
        keep = keep & (F.abs("position") >= floor_share * F.abs("edge"))
    if min_depth is not None:
        keep = keep & (F.col("depth") >= min_depth)
    found = deepest(cands, keep)
    return found.withColumn("stop", F.coalesce("stop", "edge") if else_edge else F.col("stop"))


def jump_stop(profile: DataFrame, span: int, fraction: float | None = None) -> DataFrame:
    """Per side: the largest jump against the median of the ``span`` bins before it, or the first jump over ``fraction``."""
    inside = Window.partitionBy("image", "side").orderBy("ord").rowsBetween(-span, -1)
    made = two_sides(profile).withColumn("_base", F.percentile("value", 0.5).over(inside))
    jump = F.when((F.col("ord") >= span) & (F.col("_base") > 0), F.abs(F.col("value") / F.nullif("_base", F.lit(0.0)) - 1.0))
    made = made.withColumn("_j", jump)
    if fraction is None:
        pick = F.max_by(F.when(F.col("_j").isNotNull(), F.col("position")), F.when(F.col("_j").isNotNull(), F.struct(F.col("_j"), -F.col("ord"))))
    else:
        pick = F.min_by(F.when(F.col("_j") > fraction, F.col("position")), F.when(F.col("_j") > fraction, F.col("ord")))
    return made.groupBy("image", "side").agg(pick.alias("stop"))


def step_stop(profile: DataFrame, fraction: float, half_um: float, needed: int, decode: str = "first") -> DataFrame:
    """Per side: where a run of ``needed`` bins departs from the middle's colour.

    ``first`` takes the first such run, ``strong`` the one with the largest summed departure, ``inward`` the outermost run
    that still matches, scanned from the far end.
    """
    from stratafold.functions.ordered import islands

    sides = two_sides(departure(profile, half_um))
    flag = F.col("departure") <= fraction if decode == "inward" else F.col("departure") > fraction
    if decode == "inward":
        sides = sides.withColumn("ord", -F.col("ord"))
    runs = islands(sides, ["image", "side"], "ord", flag).filter(F.col("flag") & (F.col("length") >= needed)).groupBy("image", "side", "start").agg(
        F.min_by("position", "ord").alias("position"), F.sum("departure").alias("weight"))
    if decode == "strong":
        pick = F.max_by("position", F.struct(F.round("weight", 9), -F.col("start")))
    else:
        pick = F.min_by("position", "start")
    return sides.select("image", "side").distinct().join(runs.groupBy("image", "side").agg(pick.alias("stop")), ["image", "side"], "left")


def pair_of_ends(cands: DataFrame, min_span: float, min_depth: float | None = None, bin_um: float = ALONG_BIN_UM) -> DataFrame:
    """Both ends chosen together: the deepest pair of dips at least ``min_span`` apart, else the two tissue edges.

    With ``min_depth`` a side left without a dip takes its edge and the other side still has to reach the span from there.
    For each low dip the best high dip beyond the span is one window maximum, so pairs are never listed.
    """
    ok = F.col("usable") if min_depth is None else F.col("usable") & (F.col("depth") >= min_depth)
    low, high = (F.col("side") == -1) & ok, (F.col("side") == 1) & ok
    rows = cands.groupBy("image", "bin", "position").agg(
        F.max(F.when(low, F.struct(F.col("depth"), -F.col("ord")))).alias("lo"), F.max(F.when(high, F.struct(F.col("depth"), -F.col("ord")))).alias("hi"))
    beyond = Window.partitionBy("image").orderBy("bin").rangeBetween(math.ceil(min_span / bin_um), Window.unboundedFollowing)
    best_high = F.max(F.when(F.col("hi").isNotNull(), F.struct(F.col("hi.depth").alias("d"), F.col("hi").getField("col2").alias("o"), F.col("position").alias("p")))).over(beyond)
    paired = rows.withColumn("h", best_high)
    rank = F.struct(F.round(F.col("lo.depth") + F.col("h.d"), 12), F.col("lo").getField("col2"), F.col("h.o"))
    both = F.col("lo").isNotNull() & F.col("h").isNotNull()
    chosen = paired.groupBy("image").agg(
        F.max_by(F.when(both, F.struct(F.col("position").alias("low"), F.col("h.p").alias("high"))), F.when(both, rank)).alias("pair"),
        F.count("lo").alias("n_low"), F.count("hi").alias("n_high"))
    edges = cands.groupBy("image").agg(
        F.max(F.when(F.col("side") == -1, F.col("edge"))).alias("low_edge"), F.max(F.when(F.col("side") == 1, F.col("edge"))).alias("high_edge"))
    facts = chosen.join(edges, "image")
    joined = cands.join(facts, "image")
    far_high = high & (F.col("position") - F.col("low_edge") >= min_span)
    far_low = low & (F.col("high_edge") - F.col("position") >= min_span)
    rank_own = F.struct(F.col("depth"), -F.col("ord"))
    one = joined.groupBy("image").agg(
        F.max_by(F.when(far_high, F.col("position")), F.when(far_high, rank_own)).alias("one_high"),
        F.max_by(F.when(far_low, F.col("position")), F.when(far_low, rank_own)).alias("one_low"))
    made = facts.join(one, "image")
    lone_high = F.lit(min_depth is not None) & (F.col("n_low") == 0) & (F.col("n_high") > 0)
    lone_low = F.lit(min_depth is not None) & (F.col("n_high") == 0) & (F.col("n_low") > 0)
    return made.select(
        "image", F.when(lone_high, F.col("low_edge")).when(lone_low, F.coalesce("one_low", "low_edge")).otherwise(F.coalesce("pair.low", "low_edge")).alias("low"),
        F.when(lone_high, F.coalesce("one_high", "high_edge")).when(lone_low, F.col("high_edge")).otherwise(F.coalesce("pair.high", "high_edge")).alias("high"))


def _ends(sided: DataFrame, low: Column, high: Column) -> DataFrame:
    return sided.groupBy("image").agg(low.alias("low"), high.alias("high"))


def outermost_ends(cands: DataFrame, min_span: float, share: float, floor: float) -> DataFrame:
    """On each side the outermost dip worth ``share`` of that side's deepest; ``pair_of_ends`` when the two do not reach the span."""
    side = Window.partitionBy("image", "side")
    best = F.max(F.when(F.col("usable"), F.col("depth"))).over(side)
    kept = cands.withColumn("_b", best).filter(F.col("usable") & (F.col("_b") > 0) & (F.col("depth") >= share * F.col("_b")))
    far = _ends(kept, F.min(F.when(F.col("side") == -1, F.col("position"))), F.max(F.when(F.col("side") == 1, F.col("position"))))
    base = pair_of_ends(cands, min_span, floor)
    fine = F.coalesce(F.col("o.high") - F.col("o.low") >= min_span, F.lit(False))
    return base.alias("b").join(far.alias("o"), F.col("b.image") == F.col("o.image"), "left").select(
        F.col("b.image").alias("image"), F.when(fine, F.col("o.low")).otherwise(F.col("b.low")).alias("low"), F.when(fine, F.col("o.high")).otherwise(F.col("b.high")).alias("high"))


def extended_ends(cands: DataFrame, min_span: float, share: float, floor: float) -> DataFrame:
    """The pair of ends, each moved out to the outermost dip worth ``share`` of the dip it stands on."""
    base = pair_of_ends(cands, min_span, floor)
    rows = cands.filter("usable").join(base, "image").withColumn("_at", F.when(F.col("side") == -1, F.col("low")).otherwise(F.col("high")))
    here = F.max(F.when(F.col("position") == F.col("_at"), F.col("depth"))).over(Window.partitionBy("image", "side"))
    beyond = F.when(F.col("side") == -1, F.col("position") < F.col("_at")).otherwise(F.col("position") > F.col("_at"))
    far = rows.withColumn("_h", here).filter((F.col("_h") > 0) & beyond & (F.col("depth") >= share * F.col("_h")))
    moved = far.groupBy("image").agg(F.min(F.when(F.col("side") == -1, F.col("position"))).alias("_lo"), F.max(F.when(F.col("side") == 1, F.col("position"))).alias("_hi"))
    return base.join(moved, "image", "left").select("image", F.coalesce("_lo", "low").alias("low"), F.coalesce("_hi", "high").alias("high"))


def anchored_ends(cands: DataFrame, length_um: float) -> DataFrame:
    """One end from the single deepest dip of the line, the other a fixed length away, held inside the tissue edge."""
    rank = F.struct(F.col("depth"), -F.col("side"), -F.col("ord"))
    ok = F.col("usable")
    made = cands.groupBy("image").agg(
        F.max_by(F.when(ok, F.struct("position", "side")), F.when(ok, rank)).alias("a"),
        F.max(F.when(F.col("side") == -1, F.col("edge"))).alias("low_edge"), F.max(F.when(F.col("side") == 1, F.col("edge"))).alias("high_edge"))
    at, left = F.col("a.position"), F.col("a.side") == -1
    low = F.when(left, at).otherwise(F.greatest(at - length_um, F.col("low_edge")))
    high = F.when(left, F.least(at + length_um, F.col("high_edge"))).otherwise(at)
    return made.select("image", F.coalesce(low, "low_edge").alias("low"), F.coalesce(high, "high_edge").alias("high"))


def most_stable(ladder: DataFrame, tolerance_um: float) -> DataFrame:
    """The rung whose two stops agree with the most other rungs; ties go to the largest fraction.

    ``ladder(image, fraction, low, high)`` has a fixed handful of rungs per section, so agreement is counted inside an array.
    """
    packed = ladder.groupBy("image").agg(F.collect_list(F.struct("fraction", "low", "high")).alias("rungs"))

    def near(a, b):
        return F.coalesce(F.abs(a - b) <= tolerance_um, a.isNull() & b.isNull())

    scored = F.transform("rungs", lambda one: F.struct(
        F.size(F.filter("rungs", lambda o: (o.fraction != one.fraction) & near(o.low, one.low) & near(o.high, one.high))).alias("agree"),
        one.fraction.alias("fraction"), one.low.alias("low"), one.high.alias("high")))
    return packed.select("image", F.array_max(scored).alias("b")).select("image", "b.fraction", "b.agree", "b.low", "b.high")


def dim_stop(profile: DataFrame, fraction: float, span: int, needed: int) -> DataFrame:
    """Per side: where the first stretch of ``needed`` bins dimmer than ``fraction`` of the middle's median starts; else the end.

    Bins without tissue count as 0.
    """
    from stratafold.functions.ordered import islands

    filled = profile.withColumn("value", F.coalesce("value", F.lit(0.0)))
    sides = two_sides(filled)
    reference = F.percentile(F.when(F.col("ord") <= span, F.col("value")), 0.5).over(Window.partitionBy("image"))
    # The centre bin is on both sides; one of its copies is left out of the reference.
    once = F.when((F.col("ord") <= span) & ~((F.col("ord") == 0) & (F.col("side") == -1)), F.col("value"))
    reference = F.percentile(once, 0.5).over(Window.partitionBy("image"))
    dim = sides.withColumn("_ref", reference)
    runs = islands(dim, ["image", "side"], "ord", F.col("value") <= fraction * F.col("_ref"))
    hit = F.col("flag") & (F.col("length") >= needed)
    return runs.groupBy("image", "side").agg(
        F.min_by(F.when(hit, F.col("position")), F.when(hit, F.col("ord"))).alias("_at"), F.max_by("position", "ord").alias("_end")).select(
        "image", "side", F.coalesce("_at", "_end").alias("stop"))


def solid_run(profile: DataFrame, solid: Column) -> DataFrame:
    """Ends of the run of solid bins that contains the centre, or the solid bin nearest to it."""
    from stratafold.functions.ordered import islands

    runs = islands(profile, ["image"], "bin", solid).filter("flag")
    nearest = runs.groupBy("image").agg(F.min_by("start", F.struct(F.abs("position"), F.col("position"))).alias("start"))
    return runs.join(nearest, ["image", "start"]).groupBy("image").agg(F.min("position").alias("low"), F.max("position").alias("high"))


def leashed_window(ends: DataFrame, half_um: float, inward: float, outward: float) -> DataFrame:
    """Ends clipped to within a leash of a constant half length; an inverted window falls back to the constant."""
    low = F.least(F.greatest(F.col("low"), F.lit(-half_um - outward)), F.lit(-half_um + inward))
    high = F.least(F.greatest(F.col("high"), F.lit(half_um - inward)), F.lit(half_um + outward))
    fine = F.coalesce(low < high, F.lit(False))
    return ends.select("image", F.when(fine, low).otherwise(-half_um).alias("low"), F.when(fine, high).otherwise(half_um).alias("high"))


def march(bins: DataFrame, tissue_share: float, black_share: float) -> DataFrame:
    """From the middle outwards to the last bin that is tissue and not black: ``(image, bin, position, tissue, black)`` shares.

    Null when the middle itself is off tissue.
    """
    scan = Window.partitionBy("image").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = bins.filter("position >= 0")
    centre = F.first("tissue").over(scan) >= tissue_share
    clear = F.bool_and((F.col("position") == 0) | (F.col("tissue") >= tissue_share) & (F.col("black") < black_share)).over(scan)
    made = out.withColumn("_c", centre).withColumn("_ok", clear)
    return made.groupBy("image").agg(F.max(F.when(F.col("_c") & F.col("_ok"), F.col("position"))).alias("stop"))
