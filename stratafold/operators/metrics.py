"""Scores of masks, cells and rankings; knob selection with one group held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.ordered import running_totals


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def overlap(masks: DataFrame, predicted: Column, truth: Column, *keys: str) -> DataFrame:
    """IoU, precision, recall and signed area error per key in one pass; null where nothing was drawn."""
    both, either = F.count_if(predicted & truth), F.count_if(predicted | truth)
    p, t = F.count_if(predicted), F.count_if(truth)
    drawn = masks.groupBy(*keys).agg(both.alias("both"), either.alias("either"), p.alias("p"), t.alias("t"))

    def known(c):
        return F.when(F.col("t") > 0, c)

    return drawn.select(
        *keys, known(ratio(F.col("both"), F.col("either"))).alias("iou"), known(ratio(F.col("both"), F.col("p"))).alias("precision"),
        known(ratio(F.col("both"), F.col("t"))).alias("recall"), known(F.col("p") / F.col("t") - 1).alias("area_error"))


def weighted_count(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))


def cell_shares(cells: DataFrame, drawn: Column, other: Column, inside: dict[str, Column], *keys: str) -> DataFrame:
    """Per key and rung: cells drawn in the region, kept by the rung, taken from the other region, unlabelled, claimed.

    ``cells`` has one row per pixel with ``n`` cells on it. All rungs are counted in the same pass and unpivoted afterwards.
    """
    n = F.col("n")
    parts = [weighted_count(drawn, n).alias("cells")]
    for rung, claim in inside.items():
        parts.append(F.struct(F.lit(rung).alias("rung"), weighted_count(drawn & claim, n).alias("kept"), weighted_count(claim & other, n).alias("other"),
                              weighted_count(claim & ~drawn & ~other, n).alias("unlabelled"), weighted_count(claim, n).alias("claimed")).alias(f"_{rung}"))
    made = cells.groupBy(*keys).agg(*parts).filter("cells > 0")
    return made.select(*keys, "cells", F.inline(F.array(*[F.col(f"_{rung}") for rung in inside])))


def pooled(rows: DataFrame, *keys: str) -> DataFrame:
    """Ratios of sums over sections, and the mean share of claimed cells that do not belong."""
    wrong = (F.col("claimed") - F.col("kept")) / F.greatest("claimed", F.lit(1))
    return rows.groupBy(*keys).agg(F.sum("cells").alias("cells"), (F.sum("kept") / F.sum("cells")).alias("recall"), F.avg(wrong).alias("wrong_share"))


def density_proxy(kept: Column, cells: Column, area: Column, drawn: Column) -> list[Column]:
    """Kept share, area ratio and their quotient."""
    share, size = ratio(kept, cells), ratio(area, drawn)
    return [share.alias("share"), size.alias("area_ratio"), (share / F.greatest(size, F.lit(1e-9))).alias("density")]


def ranking(scored: DataFrame, group: str, tie: str) -> DataFrame:
    """Precision, recall and F1 down the ranking of each group (score falling, ties by ``tie``), exact for groups of any size."""
    order = [F.col("probability").desc(), F.col(tie)]
    ranked = running_totals(scored, [group], order, {"rank": F.lit(1).cast("long"), "tp": F.col("label").cast("long")})
    total = scored.groupBy(group).agg(F.sum("label").cast("long").alias("positives"))
    joined = ranked.join(total, group)
    precision, recall = F.col("tp") / F.col("rank"), F.col("tp") / F.greatest("positives", F.lit(1))
    return joined.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * precision * recall / (precision + recall + 1e-9))


def ranking_summary(scored: DataFrame, group: str, tie: str) -> DataFrame:
    """Average precision and the best-F1 point per group; groups without positives have no score, not zero."""
    best = F.max_by(F.struct("f1", "precision", "recall", "probability"), F.struct(F.col("f1"), -F.col("rank")))
    made = ranking(scored, group, tie).groupBy(group).agg(
        F.count("*").alias("n"), F.first("positives").alias("positives"),
        (F.sum(F.when(F.col("label") == 1, F.col("precision"))) / F.first("positives")).alias("average_precision"), best.alias("b"))
    return made.filter("positives > 0").select(
        group, "n", "positives", "average_precision", "b.f1", "b.precision", "b.recall", F.col("b.probability").alias("threshold"))


def held_out_mean(results: DataFrame) -> DataFrame:
    """Mean average precision and mean threshold over the groups that can be graded."""
    return results.agg(F.count("*").alias("groups"), F.avg("average_precision").alias("mean_ap"), F.avg("threshold").alias("threshold"))


def honest_choice(table: DataFrame, group: str, setting: str, score: str, order: str) -> DataFrame:
    """Per held-out group: the setting with the best mean over the other groups, and its mean on the held-out one.

    The mean over the others is total minus own. Ties go to the first setting in the given order.
    """
    own = table.groupBy(group, setting, order).agg(F.sum(score).alias("s"), F.count("*").alias("n"))
    every = own.groupBy(setting).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = own.join(every, setting).withColumn("mean_rest", F.round((F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0)), 10))
    pick = F.max_by(F.struct(F.col(setting).alias("setting"), F.col("s"), F.col("n")), F.struct(F.col("mean_rest"), -F.col(order)))
    return rest.groupBy(group).agg(pick.alias("p")).select(
        group, "p.setting", (F.col("p.s") / F.col("p.n")).alias("held_out"), F.col("p.n").alias("n"))


def class_weights(labels: DataFrame, column: str, classes: int, cap: float = 20.0) -> DataFrame:
    """Inverse-frequency weight per class; absent classes count as one, weights are capped."""
    made = labels.agg(*[F.greatest(F.count_if(F.col(column) == k), F.lit(1)).alias(f"c{k}") for k in range(classes)])
    total = sum((F.col(f"c{k}") for k in range(1, classes)), F.col("c0"))
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"c{k}").alias("n"), F.least(total / (F.col(f"c{k}") * classes), F.lit(cap)).alias("weight"))
                     for k in range(classes)])
    return made.select(F.inline(rows))


def ensemble(scores: DataFrame, item: str, class_col: str, probability: str) -> DataFrame:
    """Average the members' probabilities per item and class, then take the best class; ties go to the lower class."""
    mean = scores.groupBy(item, class_col).agg(F.avg(probability).alias("p"))
    return mean.groupBy(item).agg(F.max_by(F.struct(class_col, "p"), F.struct(F.col("p"), -F.col(class_col))).alias("b")).select(
        item, f"b.{class_col}", "b.p")


def pairwise_agreement(masks: DataFrame, members: list[str], *keys: str) -> DataFrame:
    """Mean IoU over member pairs; every member's mask is one boolean column, so no self join is needed."""
    parts = [F.count_if(F.col(a) & F.col(b)) / F.greatest(F.count_if(F.col(a) | F.col(b)), F.lit(1)) for i, a in enumerate(members) for b in members[i + 1:]]
    return masks.groupBy(*keys).agg((sum(parts[1:], parts[0]) / len(parts)).alias("agreement"))
