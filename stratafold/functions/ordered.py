"""Ordered logic that stays exact when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import cut_lineage

def running_totals(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Exact inclusive running sums per group in the given total order, with no task holding a whole group.

    The rows are range-partitioned on (keys, order), so a large group spans many tasks. The placement is checkpointed,
    because a second evaluation may draw other range limits. Per (group, task) totals - one row each - give the offsets
    that are added to running sums made inside each (group, task).
    """
    named = [F.col(k) for k in keys]
    placed = cut_lineage(df.repartitionByRange(*named, *order).withColumn("_part", F.spark_partition_id()))
    groups = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    made = placed.groupBy(*groups).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    offsets = made.select(*groups, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.select("*", *[F.sum(c).over(inside).alias(f"_r_{n}") for n, c in totals.items()])
    out = rows.join(offsets, groups)
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])


def next_in_ring(vertices: DataFrame, keys: list[str], sequence: str, values: list[str]) -> DataFrame:
    """``next_<value>`` of the following vertex, the last one wrapping to the first.

    Vertices are range-partitioned on (keys, sequence), so a polygon that holds a third of all rows spans many tasks whatever its vertex
    numbers are; the placement is checkpointed, as in ``running_totals``. Only the first vertex of each (polygon, task) goes through the
    window over a polygon.
    """
    placed = cut_lineage(vertices.repartitionByRange(*[F.col(k) for k in keys], F.col(sequence)).withColumn("_part", F.spark_partition_id()))
    packed = F.struct(*values)
    ring = Window.partitionBy(*keys).orderBy("_part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = placed.groupBy(*keys, "_part").agg(F.min_by(packed, sequence).alias("_head"))
    heads = heads.select(*keys, "_part", F.coalesce(F.lead("_head").over(ring), F.first("_head").over(whole)).alias("_after"))
    inside = Window.partitionBy(*keys, "_part").orderBy(sequence)
    led = placed.withColumn("_next", F.lead(packed).over(inside)).join(heads, [*keys, "_part"])
    nxt = F.coalesce(F.col("_next"), F.col("_after"))
    return led.select(*vertices.columns, *[nxt[v].alias(f"next_{v}") for v in values])


def islands(df: DataFrame, keys: list[str], position: str, flag: Column) -> DataFrame:
    """Runs of equal ``flag`` along an ordered bounded line such as a ray: adds ``flag``, ``start``, ``length`` of the run."""
    line = Window.partitionBy(*keys).orderBy(position)
    marked = df.withColumn("_flag", flag)
    marked = marked.withColumn("_island", F.row_number().over(line) - F.row_number().over(Window.partitionBy(*keys, "_flag").orderBy(position)))
    run = Window.partitionBy(*keys, "_flag", "_island")
    return marked.withColumn("start", F.min(position).over(run)).withColumn("length", F.count("*").over(run)).withColumnRenamed(
        "_flag", "flag").drop("_island")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles of groups of any size.

    Equal values are counted first; the running count of the ordered distinct values then tells which value sits at each
    wanted rank. Built-in ``percentile`` keeps a whole group's values in one task and is left to groups bounded by a canvas
    or a ray.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    summed = running_totals(counted, keys, [F.col(value)], {"_cum": F.col("_n")})
    totals = summed.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    joined = summed.join(totals, keys) if keys else summed.join(totals)  # without keys the totals are one row
    picks = []
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(share)
        picks += [F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
                  F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"), F.first(at - F.floor(at)).alias(f"_w_{name}")]
    found = joined.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in shares])


def median_without_own(df: DataFrame, scope: list[str], group: str, value: str, tie: str) -> DataFrame:
    """Per (scope, group): the exact median over the rows of all other groups, without pairing groups with rows.

    With all rows ranked once, removing a group's own ranks ``r_0 < r_1 < ..`` moves the i-th remaining row to rank
    ``i + #{t : r_t - t <= i}``. That count is one aggregate per group, and the value is looked up by its rank.
    """
    rows = df.select(*scope, group, value, tie)
    one = F.lit(1).cast("long")
    ranked = running_totals(rows, scope, [F.col(value), F.col(tie)], {"_rank": one}).withColumn("_rank", F.col("_rank") - 1)
    own = running_totals(ranked, [*scope, group], [F.col("_rank")], {"_t": one}).withColumn("_t", F.col("_t") - 1)
    sizes = own.groupBy(*scope, group).agg(F.count("*").alias("_m"))
    alls = sizes.groupBy(*scope).agg(F.sum("_m").alias("_all"))
    wanted = (sizes.join(alls, scope) if scope else sizes.join(alls)).withColumn("_rest", F.col("_all") - F.col("_m")).filter("_rest > 0")
    wanted = wanted.withColumn("_lo", F.floor((F.col("_rest") - 1) / 2)).withColumn("_hi", F.ceil((F.col("_rest") - 1) / 2))
    gap = F.col("_rank") - F.col("_t")
    moved = own.join(wanted, [*scope, group]).groupBy(*scope, group).agg(
        (F.first("_lo") + F.count_if(gap <= F.col("_lo"))).alias("_glo"), (F.first("_hi") + F.count_if(gap <= F.col("_hi"))).alias("_ghi"))
    at = ranked.select(*scope, F.col("_rank"), F.col(value).alias("_v"))
    low = moved.join(at.withColumnRenamed("_rank", "_glo").withColumnRenamed("_v", "_vlo"), [*scope, "_glo"])
    both = low.join(at.withColumnRenamed("_rank", "_ghi").withColumnRenamed("_v", "_vhi"), [*scope, "_ghi"])
    return both.select(*scope, group, ((F.col("_vlo") + F.col("_vhi")) / 2).alias("median"))
