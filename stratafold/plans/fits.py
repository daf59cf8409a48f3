"""Constants fitted over training groups: medians, slopes and per-direction priors, always with one group held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.ordered import exact_percentiles, median_without_own
from stratafold.operators.frames import BIN_UM, projections

SIDE_MIN_PX = 20


def region_slices(framed: DataFrame, region: Column, near: DataFrame, bin_um: float = BIN_UM) -> DataFrame:
    """Slices of a region by depth from its near border: offset, lowest and highest ``along``; thin slices are dropped."""
    inside = framed.filter(region).join(near, "image")
    depth = F.floor((F.col("across") - F.col("near")) / bin_um)
    return inside.groupBy("image", depth.alias("slice")).agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high")).filter(
        F.col("n") >= SIDE_MIN_PX).withColumn("offset", F.col("slice") * bin_um + bin_um / 2)


def measure(framed: DataFrame, region: Column, bin_um: float = BIN_UM) -> DataFrame:
    """Numbers of a region in the band frame: near border, depth, and lines through its two ends; needs three slices."""
    near = framed.filter(region).groupBy("image").agg(F.min("across").alias("near"), (F.max("across") - F.min("across")).alias("depth"))
    ends = region_slices(framed, region, near, bin_um).groupBy("image").agg(
        F.count("*").alias("slices"), F.regr_slope("low", "offset").alias("slope_low"), F.regr_intercept("low", "offset").alias("low"),
        F.regr_slope("high", "offset").alias("slope_high"), F.regr_intercept("high", "offset").alias("high")).filter("slices >= 3")
    return near.join(ends, "image")


def side_middle(framed: DataFrame, region: Column, bin_um: float = BIN_UM) -> DataFrame:
    """Median over ``along`` bins of the region's nearest ``across``: the middle of its side rather than its corner.

    Needs three bins of at least twenty pixels; the number of bins is bounded by the frame.
    """
    inside = framed.filter(region)
    start = inside.groupBy("image").agg(F.min("along").alias("start"), F.max("along").alias("stop"))
    bins = inside.join(start, "image").filter(F.col("along") < F.col("stop") + bin_um).groupBy(
        "image", F.floor((F.col("along") - F.col("start")) / bin_um).alias("b")).agg(F.count("*").alias("n"), F.min("across").alias("edge"))
    return bins.filter(F.col("n") >= SIDE_MIN_PX).groupBy("image").agg(F.count("*").alias("bins"), F.percentile("edge", 0.5).alias("middle")).filter(
        "bins >= 3").select("image", "middle")


def fold_medians(measured: DataFrame, group: str, item: str, names: list[str]) -> DataFrame:
    """Per held-out group: the median of each measured number over all other groups, one column per number."""
    stacked = measured.select(group, item, F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])))
    medians = median_without_own(stacked, ["measure"], group, "value", item)
    return medians.groupBy(group).agg(*[F.max(F.when(F.col("measure") == n, F.col("median"))).alias(n) for n in names])


def fitted_constants(measured: DataFrame, names: list[str]) -> DataFrame:
    """The median of each measured number over all birds, as one row."""
    stacked = measured.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])))
    medians = exact_percentiles(stacked, ["measure"], "value", {"median": 0.5})
    return medians.agg(*[F.max(F.when(F.col("measure") == n, F.col("median"))).alias(n) for n in names])


def direction_extents(framed: DataFrame, mask: Column, directions: int = 16, share: float | None = None) -> DataFrame:
    """Array of the mask's reach along each fanned direction, all directions in one pass.

    ``share`` trims thin fingers by a percentile; a section's canvas bounds its group.
    """
    p = framed.filter(mask).select("image", "bird", projections(F.col("along"), F.col("across"), directions).alias("p"))
    reach = [F.max(F.col("p")[k]) if share is None else F.percentile(F.col("p")[k], share) for k in range(directions)]
    return p.groupBy("image", "bird").agg(F.array(*reach).alias("offsets"), F.array(*[F.avg(F.col("p")[k]) for k in range(directions)]).alias("centre"))


def reach_prior(training: DataFrame, group: str) -> DataFrame:
    """Per held-out group and direction: slope (clipped to 0-1.5) and intercept of offset over tissue reach, from the others.

    ``training(group, k, reach, offset)``. Least-squares sums are subtracted, so no fold is refitted.
    """
    x, y = F.col("reach"), F.col("offset")
    parts = {"n": F.count("*").cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x)}
    own = training.groupBy(group, "k").agg(*[v.alias(n) for n, v in parts.items()])
    every = own.groupBy("k").agg(*[F.sum(n).alias(f"all_{n}") for n in parts])
    rest = own.join(every, "k").select(group, "k", *[(F.col(f"all_{n}") - F.col(n)).alias(n) for n in parts]).filter("n > 0")
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when(spread > 1e-9, F.least(F.greatest((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)), F.lit(1.5))).otherwise(0.0)
    return rest.withColumn("slope", slope).select(group, "k", "slope", (F.col("sy") / F.col("n") - F.col("slope") * F.col("sx") / F.col("n")).alias("intercept"))


def median_radii(training: DataFrame, group: str) -> DataFrame:
    """The prior without the tissue's reach: slope 0 and, as intercept, the median radius of the other groups per direction.

    ``training(group, image, k, radius)``, with radii about the centre that they will be added back to.
    """
    found = median_without_own(training, ["k"], group, "radius", "image")
    return found.select(group, "k", F.lit(0.0).alias("slope"), F.col("median").alias("intercept"))


def leash(prior: Column, target: Column, um: float) -> Column:
    """The prior, allowed to move at most ``um`` towards a target."""
    return prior + F.least(F.greatest(target - prior, F.lit(-um)), F.lit(um))
