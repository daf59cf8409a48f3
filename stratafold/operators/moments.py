"""Principal axes, extents and boxes of pixel sets, all from mergeable sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.frames import signed_distance

EDGE_SHARES = (0.10, 0.90)


def whole_moments(pixels: DataFrame, *keys: str) -> DataFrame:
    """``ay, ax, vy, vx, vyx``: means, variances and covariance of whole-number places from exact integer sums.

    They do not depend on the order of the rows, so a straight or symmetric piece has a covariance of exactly zero.
    """
    y, x, n = F.col("y").cast("decimal(10,0)"), F.col("x").cast("decimal(10,0)"), F.col("_n").cast("decimal(12,0)")
    s = pixels.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(e).cast("decimal(18,0)").alias(a) for a, e in (
        ("_y", y), ("_x", x), ("_yy", y * y), ("_xx", x * x), ("_yx", y * x))])

    def spread(both: str, a: str, b: str) -> Column:
        return (n * F.col(both) - F.col(a) * F.col(b)).cast("double") / (F.col("_n") * F.col("_n"))

    return s.select(*keys, (F.col("_y").cast("double") / F.col("_n")).alias("ay"), (F.col("_x").cast("double") / F.col("_n")).alias("ax"),
                    spread("_yy", "_y", "_y").alias("vy"), spread("_xx", "_x", "_x").alias("vx"), spread("_yx", "_y", "_x").alias("vyx"))


def line_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Total-least-squares line: centre and unit direction of the greatest spread, as a closed form of the second moments."""
    m = pixels.groupBy(*keys).agg(
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("vyx"))
    angle = F.atan2(2 * F.col("vyx"), F.col("vx") - F.col("vy")) * 0.5
    return m.select(*keys, "cy", "cx", F.sin(angle).alias("dy"), F.cos(angle).alias("dx"))


def weighted_axis(pixels: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """Angle in degrees of the long axis of a weighted pixel cloud, in (-90, 90]."""
    w = pixels.withColumn("_w", weight)
    s = w.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in (
        ("w", F.col("_w")), ("wy", F.col("_w") * F.col("y")), ("wx", F.col("_w") * F.col("x")), ("wyy", F.col("_w") * F.col("y") * F.col("y")),
        ("wxx", F.col("_w") * F.col("x") * F.col("x")), ("wyx", F.col("_w") * F.col("y") * F.col("x")))])
    my, mx = F.col("wy") / F.col("w"), F.col("wx") / F.col("w")
    vy, vx, vyx = F.col("wyy") / F.col("w") - my * my, F.col("wxx") / F.col("w") - mx * mx, F.col("wyx") / F.col("w") - my * mx
    return s.select(*keys, F.degrees(F.atan2(2 * vyx, vx - vy) * 0.5).alias("degrees"))


def extent(values: Column, low: float = 0.005, high: float = 0.995) -> Column:
    """Trimmed reach as an array (low, high), interpolated linearly."""
    return F.percentile(values, F.array(F.lit(low), F.lit(high)))


def orient(patch: DataFrame, bands: DataFrame, height: int, width: int) -> DataFrame:
    """Turn each band's normal so that its marker lies beyond the middle of the patch."""
    ny, nx = F.col("normal_y"), F.col("normal_x")
    reach = patch.select("image", "y", "x").join(bands.select("image", "normal_y", "normal_x"), "image").groupBy("image").agg(
        extent(signed_distance(ny, nx, height, width), *EDGE_SHARES).alias("e"))
    marker = ny * (F.col("marker_y") - height / 2) + nx * (F.col("marker_x") - width / 2)
    sign = F.when(marker > (F.col("e")[0] + F.col("e")[1]) / 2, 1.0).otherwise(-1.0)
    return bands.join(reach, "image").withColumn("_s", sign).withColumn("normal_y", ny * F.col("_s")).withColumn("normal_x", nx * F.col("_s")).drop("_s", "e")


def box_of(pixels: DataFrame, lines: DataFrame, key: str = "image") -> DataFrame:
    """The rectangle along a line that brackets a region between its trimmed extents, angle as sine and cosine of its double."""
    from stratafold.functions.scalars import across_line, along_line

    args = (F.col("y"), F.col("x"), F.col("cy"), F.col("cx"), F.col("dy"), F.col("dx"))
    e = pixels.join(lines, key).groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("cy", "cx", "dy", "dx")], extent(along_line(*args)).alias("a"), extent(across_line(*args)).alias("c"))
    along, across = (F.col("a")[0] + F.col("a")[1]) / 2, (F.col("c")[0] + F.col("c")[1]) / 2
    angle = F.atan2("dy", "dx") * 2
    return e.select(
        key, (F.col("cy") + along * F.col("dy") - across * F.col("dx")).alias("centre_y"), (F.col("cx") + along * F.col("dx") + across * F.col("dy")).alias("centre_x"),
        ((F.col("a")[1] - F.col("a")[0]) / 2).alias("half_along"), ((F.col("c")[1] - F.col("c")[0]) / 2).alias("half_across"),
        F.sin(angle).alias("sin2t"), F.cos(angle).alias("cos2t"))


def section_measures(framed: DataFrame, bands: DataFrame, region: Column, slab_um: float, slice_um: float) -> DataFrame:
    """What a section reports about itself: tissue depth, span behind the line, spread, band width, and the wobble of the drawn side.

    Everything but the wobble is one aggregate over the pixels; the wobble has a second one over its slices.
    """
    tissue, slab = F.col("tissue"), F.col("across").between(0, slab_um)
    facts = framed.groupBy("image").agg(
        (F.max(F.when(tissue, F.col("across"))) - F.min(F.when(tissue, F.col("across")))).alias("tissue_depth"),
        F.min(F.when(tissue & slab, F.col("along"))).alias("span_low"), F.max(F.when(tissue & slab, F.col("along"))).alias("span_high"),
        extent(F.when(tissue, F.col("across")), *EDGE_SHARES).alias("e"))
    slices = framed.filter(region).groupBy("image", F.floor(F.col("along") / slice_um).alias("s")).agg(F.min("across").alias("edge"))
    wobble = slices.groupBy("image").agg(F.stddev_pop("edge").alias("wobble"))
    widths = bands.select("image", ((F.col("ncm_offset") - F.col("cmm_offset")) * 8).alias("band_um"), ((F.col("span_high") - F.col("span_low")) * 4).alias("half_um"))
    return facts.join(widths, "image").join(wobble, "image", "left").withColumn("spread", F.col("e")[1] - F.col("e")[0])


def capped_width(framed: DataFrame, dark: Column, floor_um: float, width_um: float, bin_um: float, least_px: int, share: float) -> DataFrame:
    """A band's width, cut at the first bin behind the near border in which enough pixels are dark."""
    bins = framed.filter((F.col("across") < -floor_um) & (F.col("across") > -width_um)).groupBy(
        "image", F.floor(-F.col("across") / bin_um).alias("bin")).agg(F.count("*").alias("n"), F.avg(dark.cast("int")).alias("dark"))
    first = bins.groupBy("image").agg(F.min(F.when((F.col("n") >= least_px) & (F.col("dark") >= share), F.col("bin") * bin_um)).alias("cut"))
    return framed.select("image").distinct().join(first, "image", "left").select("image", F.coalesce("cut", F.lit(width_um)).alias("width_um"))
