"""Voting grid in the band frame: which bins sections call a region, built for all and for all but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.frames import ACROSS_HIGH_UM, ACROSS_LOW_UM, ALONG_LIMIT_UM, BIN_UM, bin_index, in_atlas


def with_bins(framed: DataFrame, bin_um: float = BIN_UM, keep_outside: bool = False) -> DataFrame:
    """Pixels with their grid bin. Pixels off the grid cast no vote; with ``keep_outside`` they stay, without a bin."""
    inside = in_atlas(F.col("along"), F.col("across"))
    binned = framed.withColumn("bin", F.when(inside, bin_index(F.col("along"), F.col("across"), bin_um)))
    return binned if keep_outside else binned.filter(inside)


def votes(binned: DataFrame, hit: Column) -> DataFrame:
    """Share of pixels called the region and number of voters, per bin."""
    return binned.groupBy("bin").agg(F.avg(hit.cast("int")).alias("share"), F.count("*").alias("voters"))


def paint(binned: DataFrame, vote: DataFrame, share: float, voters: int) -> DataFrame:
    """A binned decision back on the pixels. The grid has a fixed number of bins, so the kept ones are small by construction."""
    kept = vote.filter((F.col("share") >= share) & (F.col("voters") >= voters)).select("bin", F.lit(True).alias("painted"))
    return binned.join(F.broadcast(kept), "bin", "left").withColumn("painted", F.coalesce("painted", F.lit(False)))


def votes_without_own(binned: DataFrame, hit: Column, group: str) -> DataFrame:
    """Per (group, bin): share and voters over all other groups, as total minus own. One aggregate, no refit per group."""
    own = binned.groupBy(group, "bin").agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("n"))
    total = own.groupBy("bin").agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))
    left = own.join(total, "bin")
    n = F.col("all_n") - F.col("n")
    return left.select(group, "bin", F.coalesce((F.col("all_hits") - F.col("hits")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("share"), n.alias("voters"))


def leave_one_out(binned: DataFrame, hit: Column, group: str, share: float, voters: int) -> DataFrame:
    """Per group: pixels drawn, found and in both, when the vote of the others is painted on it."""
    rule = votes_without_own(binned, hit, group).filter((F.col("share") >= share) & (F.col("voters") >= voters)).select(group, "bin")
    per_bin = binned.groupBy(group, "bin").agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("drawn"))
    scored = per_bin.join(rule.withColumn("_kept", F.lit(True)), [group, "bin"], "left")
    kept = F.coalesce("_kept", F.lit(False))
    return scored.groupBy(group).agg(
        F.sum("drawn").alias("drawn"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(kept, F.col("drawn"))), F.lit(0)).alias("both"))


def footprint(vote: DataFrame, share: float, voters: int, bin_um: float = BIN_UM) -> DataFrame:
    """Extent and area of the kept bins."""
    rows = int((ACROSS_HIGH_UM - ACROSS_LOW_UM) / bin_um)
    kept = vote.filter((F.col("share") >= share) & (F.col("voters") >= voters)).select(
        (F.floor(F.col("bin") / rows) * bin_um - ALONG_LIMIT_UM).alias("a"), (F.col("bin") % rows * bin_um + ACROSS_LOW_UM).alias("c"))
    return kept.agg(F.count("*").alias("bins"), (F.count("*") * (bin_um * bin_um / 1e6)).alias("area_mm2"), F.min("c").alias("across_low"),
                    (F.max("c") + bin_um).alias("across_high"), F.min("a").alias("along_low"), (F.max("a") + bin_um).alias("along_high"))
