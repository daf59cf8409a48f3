"""Ray tables: pixels re-indexed as (ray, step), runs of dark cells, and scores along and across rays.

Keys are ``image`` and ``ray``. A ray and the border of one section are bounded by the canvas (a few hundred cells), so
windows over them are small whatever the number of sections; one shuffle on ``image`` serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.constants import ACROSS_BIN_UM, ALONG_BIN_UM
from stratafold.functions.ordered import islands

RAY = ("image", "ray")


def bins(um: float, size: float, least: int = 1) -> int:
    """A length in micrometres as a whole number of bins, at least ``least``."""
    return max(int(round(um / size)), least)


def along_ray(lo: int | None = None, hi: int | None = None):
    w = Window.partitionBy(*RAY).orderBy("step")
    return w if lo is None else w.rowsBetween(lo, hi)


def ray_cells(framed: DataFrame, low_um: float, high_um: float | None) -> DataFrame:
    """Pixels in front of the line and inside the along window, with their ray and step.

    Without ``high_um`` there is no window: rays are numbered from ``low_um`` both ways.
    """
    inside = framed.filter(F.col("across") >= 0)
    if high_um is not None:
        inside = inside.filter(F.col("along").between(low_um, high_um))
    return inside.withColumn("ray", F.rint((F.col("along") - low_um) / ALONG_BIN_UM).cast("long")).withColumn(
        "step", F.rint(F.col("across") / ACROSS_BIN_UM).cast("long"))


def ray_table(cells: DataFrame, solid: Column, value: Column, barrier: Column | None = None) -> DataFrame:
    """Every (ray, step) cell of each section: pixels, seen, black, mean.

    A cell is black when most of its pixels are not solid or, with a barrier, when any barrier pixel lands in it. Cells
    without pixels are not black. The grid of a section is as large as its largest ray and step.
    """
    dark = F.sum(solid.cast("int")) * 2 < F.count("*") if barrier is None else F.bool_or(barrier)
    made = cells.groupBy("image", "ray", "step").agg(F.count("*").alias("n"), dark.alias("black"), F.avg(value).alias("mean"))
    size = made.groupBy("image").agg(F.max("ray").alias("_r"), F.max("step").alias("_s"))
    grid = size.withColumn("ray", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r")))).withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s"))))
    return grid.join(made, ["image", "ray", "step"], "left").select(
        "image", "ray", "step", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("seen"), F.coalesce("black", F.lit(False)).alias("black"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"))


def first_wide_gap(table: DataFrame, needed: int) -> DataFrame:
    """Per ray: ``stop``, the start of the first black run of at least ``needed`` steps; ``width`` when there is none.

    A run that reaches the last step is the outside of the section and always counts.
    """
    runs = islands(table, list(RAY), "step", F.col("black"))
    last = Window.partitionBy(*RAY)
    wide = F.col("flag") & ((F.col("length") >= needed) | (F.col("start") + F.col("length") == F.col("width")))
    return runs.withColumn("width", F.max("step").over(last) + 1).groupBy(*RAY).agg(
        F.max("width").alias("width"), F.min(F.when(wide, F.col("start"))).alias("_stop")).select(
        *RAY, "width", F.coalesce("_stop", "width").alias("stop"), F.col("_stop").isNotNull().alias("found"))


def runs_in_order(line: DataFrame, keys: list[str], order: str, flag: Column, needed: int) -> DataFrame:
    """Maximal runs of ``flag`` of at least ``needed``: first position in scan order and length."""
    runs = islands(line, keys, order, flag).filter((F.col("flag")) & (F.col("length") >= needed))
    return runs.select(*keys, F.col("start").alias("leading"), "length").distinct()


def run_members(line: DataFrame, keys: list[str], order: str, flag: Column, needed: int, name: str) -> DataFrame:
    """Adds ``name``: the row belongs to a run of at least ``needed``."""
    return islands(line, keys, order, flag).withColumn(name, F.col("flag") & (F.col("length") >= needed)).drop("flag", "start", "length")


def crosses_gap(table: DataFrame, limit: int) -> DataFrame:
    """Per ray: does it pass through a black run of at least ``limit`` steps."""
    runs = islands(table, list(RAY), "step", F.col("black"))
    return runs.groupBy(*RAY).agg(F.bool_or(F.col("flag") & (F.col("length") >= limit)).alias("crosses"))


def before_barrier(table: DataFrame, barrier: Column) -> DataFrame:
    """Adds ``kept``: no barrier on the same ray at or before this step."""
    return table.withColumn("kept", F.coalesce(F.max(barrier.cast("int")).over(along_ray(Window.unboundedPreceding, 0)), F.lit(0)) == 0)


def outermost_label(cells: DataFrame, drawn: Column, width: DataFrame) -> DataFrame:
    """Per ray: the step just past the last drawn one, ``width`` where nothing was drawn."""
    last = cells.filter(drawn).groupBy(*RAY).agg((F.max("step") + 1).alias("_last"))
    return width.join(last, list(RAY), "left").select(*RAY, "width", F.coalesce("_last", "width").alias("border"))


def halo(df: DataFrame, position: str, n: Column, size: int, mode: str) -> DataFrame:
    """Copies of the cells near both ends beyond the ends, so that fixed frames see a padded line.

    ``nearest`` repeats the end cell, ``reflect`` mirrors the line about its edge. Copies carry ``_copy``.
    """
    at = F.col(position)
    steps = F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long"))
    if mode == "nearest":
        before = F.when(at == 0, F.transform(steps, lambda k: -k)).otherwise(F.array().cast("array<long>"))
        after = F.when(at == n - 1, F.transform(steps, lambda k: n - 1 + k)).otherwise(F.array().cast("array<long>"))
    else:
        before = F.when(at < size, F.array(-1 - at)).otherwise(F.array().cast("array<long>"))
        after = F.when(at >= n - size, F.array(2 * n - 1 - at)).otherwise(F.array().cast("array<long>"))
    own = F.array(at.cast("long"))
    copies = df.withColumn("_at", F.explode(F.concat(own, before, after)))
    return copies.withColumn("_copy", F.col("_at") != at).withColumn(position, F.col("_at")).drop("_at")


def box_mean(df: DataFrame, keys: list[str], position: str, n: Column, size: int, mode: str, by_place: bool = False, **values: Column) -> DataFrame:
    """Running means of ``size`` cells along a line with padded ends; an even window leans to the left.

    ``by_place`` finds the cells of a window by their position, so places without a cell add nothing, instead of by their order.
    """
    left = size // 2
    line = Window.partitionBy(*keys).orderBy(position)
    w = line.rangeBetween(-left, size - 1 - left) if by_place else line.rowsBetween(-left, size - 1 - left)
    padded = halo(df, position, n, size, mode) if size > 1 else df.withColumn("_copy", F.lit(False))
    return padded.select("*", *[F.avg(c).over(w).alias(name) for name, c in values.items()]).filter(~F.col("_copy")).drop("_copy")


def covered_mean(table: DataFrame, size: int, axis: str, value: Column, name: str, rays: Column, width: Column, mode: str = "nearest") -> DataFrame:
    """Average over ``size`` cells along the band (``ray``) or across it (``step``), weighted by coverage."""
    keys, n = (["image", "step"], rays) if axis == "ray" else (list(RAY), width)
    made = box_mean(table, keys, axis, n, size, mode, _total=F.when(F.col("seen"), value).otherwise(0.0), _weight=F.col("seen").cast("double"))
    return made.withColumn(name, F.col("_total") / F.greatest("_weight", F.lit(1e-6))).drop("_total", "_weight")


def filled_mean(table: DataFrame) -> DataFrame:
    """Adds ``filled``: cells without pixels are held at the mean of their own ray."""
    ray = Window.partitionBy(*RAY)
    own = F.avg(F.when(F.col("seen"), F.col("mean"))).over(ray)
    return table.withColumn("filled", F.when(F.col("seen"), F.col("mean")).otherwise(F.coalesce(own, F.lit(0.0))))


def dip_stops(table: DataFrame, gap: DataFrame, fraction: float, rays: Column, width: Column, base_um=600.0, smooth_along_um=80.0,
              smooth_across_um=56.0, wide_um=80.0) -> DataFrame:
    """Per ray: where brightness first stays below ``fraction`` of that ray's own inner median, inside its gap stop."""
    base, needed = bins(base_um, ACROSS_BIN_UM, 2), bins(wide_um, ACROSS_BIN_UM)
    smoothed = covered_box(table, bins(smooth_along_um, ALONG_BIN_UM), bins(smooth_across_um, ACROSS_BIN_UM), rays, width)
    limited = smoothed.join(gap.select(*RAY, F.col("stop").alias("limit")), list(RAY))
    ray = Window.partitionBy(*RAY)
    inner = limited.withColumn("reference", F.percentile(F.when(F.col("step") < base, F.col("profile")), 0.5).over(ray))
    searched = inner.filter((F.col("limit") > base) & (F.col("step") >= base) & (F.col("step") < F.col("limit")) & (F.col("reference") > 0))
    runs = runs_in_order(searched, list(RAY), "step", F.col("profile") < fraction * F.col("reference"), needed)
    first = runs.groupBy(*RAY).agg(F.min("leading").alias("_dip"))
    return gap.join(first, list(RAY), "left").select(*RAY, "width", F.coalesce("_dip", "width").alias("stop"))


def covered_box(table: DataFrame, along: int, across: int, rays: Column, width: Column) -> DataFrame:
    """Coverage-weighted mean over a rectangle of cells, edges mirrored: two one-dimensional passes."""
    first = box_mean(table, ["image", "step"], "ray", rays, along, "reflect",
                     _t=F.when(F.col("seen"), F.col("mean")).otherwise(0.0), _w=F.col("seen").cast("double"))
    both = box_mean(first, list(RAY), "step", width, across, "reflect", _total=F.col("_t"), _weight=F.col("_w"))
    return both.withColumn("profile", F.col("_total") / F.greatest("_weight", F.lit(1e-6))).drop("_t", "_w", "_total", "_weight")


def pair_score(table: DataFrame, rays: Column, width: Column, reach: int = 6, smooth: int = 3) -> DataFrame:
    """Adds ``score``: crest minus trough where the cell is the trough of its neighbourhood along the ray, else 0."""
    smoothed = covered_mean(table, smooth, "ray", F.col("mean"), "profile", rays, width, "reflect")
    near = along_ray(-reach, reach)
    return smoothed.withColumn("_hi", F.max("profile").over(near)).withColumn("_lo", F.min("profile").over(near)).withColumn(
        "score", F.when(F.col("profile") <= F.col("_lo"), F.col("_hi") - F.col("profile")).otherwise(0.0)).drop("_hi", "_lo", "profile")


def strongest(scored: DataFrame, usable: Column, width: DataFrame) -> DataFrame:
    """Per ray: the usable step with the highest ``score``, the first on ties; ``width`` when none is usable."""
    best = scored.filter(usable).groupBy(*RAY).agg(F.max_by("step", F.struct(F.col("score"), -F.col("step"))).alias("_at"))
    return width.join(best, list(RAY), "left").select(*RAY, "width", F.coalesce("_at", "width").alias("stop"))


def ridge_score(table: DataFrame, width: Column, half_um=32.0, skip_um=24.0, flank_um=48.0, valley: bool = False) -> DataFrame:
    """Adds ``score``: a thin strip against the brighter of its two flanks, or with ``valley`` how much darker than the darker one."""
    middle, flank = bins(2 * half_um, ACROSS_BIN_UM), bins(flank_um, ACROSS_BIN_UM)
    shift = bins(skip_um + flank_um / 2.0, ACROSS_BIN_UM)
    filled = filled_mean(table)
    a = box_mean(filled, list(RAY), "step", width, middle, "nearest", _middle=F.col("filled"))
    b = box_mean(a, list(RAY), "step", width, flank, "nearest", _flank=F.col("filled"))
    ray, whole = along_ray(), along_ray(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = F.coalesce(F.lag("_flank", shift).over(ray), F.first("_flank").over(whole))
    outer = F.coalesce(F.lead("_flank", shift).over(ray), F.last("_flank").over(whole))
    flanks = b.withColumn("_inner", inner).withColumn("_outer", outer)
    score = F.least("_inner", "_outer") - F.col("_middle") if valley else F.col("_middle") - F.greatest("_inner", "_outer")
    return flanks.withColumn("score", score).drop("_middle", "_flank", "_inner", "_outer", "filled")


def oriented(scored: DataFrame, size_along: int, size_across: int, rays: Column, width: Column) -> DataFrame:
    """A score that continues along the band minus one that runs across it."""
    a = covered_mean(scored, size_along, "ray", F.col("score"), "_along", rays, width)
    b = covered_mean(a, size_across, "step", F.col("score"), "_across", rays, width)
    return b.withColumn("score", F.col("_along") - F.col("_across")).drop("_along", "_across")


def rim_edge(table: DataFrame, rays: Column, width: Column, span: int, shift: int, trend: int) -> DataFrame:
    """Adds ``score``: step up in brightness from just inside to just outside a cell, minus its own trend across the band."""
    filled = filled_mean(table)
    boxed = box_mean(filled, list(RAY), "step", width, span, "nearest", _box=F.col("filled"))
    ray, whole = along_ray(), along_ray(Window.unboundedPreceding, Window.unboundedFollowing)
    jump = F.coalesce(F.lead("_box", shift).over(ray), F.last("_box").over(whole)) - F.coalesce(F.lag("_box", shift).over(ray), F.first("_box").over(whole))
    stepped = boxed.withColumn("_jump", jump)
    made = covered_mean(stepped, trend, "step", F.col("_jump"), "_trend", rays, width)
    return made.withColumn("score", F.col("_jump") - F.col("_trend")).drop("filled", "_box", "_jump", "_trend")


def tissue_limit(table: DataFrame, black_level: float, run: int) -> DataFrame:
    """Per ray: where the outer surface begins, the first stretch of ``run`` empty cells; beyond the ray counts as empty."""
    left = run // 2
    near = along_ray(-left, run - 1 - left)
    empty = (~F.col("seen")) | (F.col("mean") < black_level)
    full = F.count_if(~empty).over(near) == 0
    marked = table.withColumn("_full", full)
    return marked.groupBy(*RAY).agg(F.min(F.when(F.col("_full"), F.col("step"))).alias("_first"), (F.max("step") + 1).alias("width")).select(
        *RAY, "width", F.greatest(F.coalesce(F.col("_first") - left, "width"), F.lit(1)).alias("stop"))
