"""Evaluation jobs: what may be scored, hard negatives, parameter sweeps, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import HARD_NEGATIVE_FRACTION, HARD_NEGATIVE_POOL_FACTOR, NEGATIVES_PER_POSITIVE
from stratafold.functions.ordered import running_totals


def scoreable(archive: DataFrame, blind: tuple[str, ...] = ("window", "blank")) -> DataFrame:
    """Adds ``scoreable``: blind-clicked rows and every negative. Positives of assisted passes only train."""
    return archive.withColumn("scoreable", F.col("source").isin(*blind) | (F.col("label") == 0))


def refuse_test_rows(archive: DataFrame) -> DataFrame:
    """Training rows must not come from the blind test grid; the check fails the job where such a row is read."""
    leak = F.when(F.col("from_test_grid"), F.raise_error(F.lit("the archive contains test-grid rows")).cast("boolean")).otherwise(F.lit(True))
    return archive.filter(leak)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact global rank without bringing the table into one task."""
    return running_totals(df, [], order, {name: F.lit(1).cast("long")})


def negative_sample(archive: DataFrame, item: str, draw: Column) -> DataFrame:
    """Negatives shown in one epoch: half of the budget from the highest-scored pool, the rest from outside it.

    The budget is twenty per positive, the pool twice the hard half. ``draw`` is a deterministic number per row whose
    order is the random order of drawing; the sizes are two counts, one row.
    """
    counts = archive.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    budget = F.least("negatives", F.col("positives") * NEGATIVES_PER_POSITIVE)
    sizes = counts.select("negatives", budget.alias("budget"), F.rint(budget * HARD_NEGATIVE_FRACTION).cast("long").alias("hard")).withColumn(
        "pool", F.col("hard") * HARD_NEGATIVE_POOL_FACTOR)
    negatives = archive.filter("label = 0").select(item, "probability", draw.alias("_draw"))
    by_score = ranked(negatives, [F.col("probability").desc(), F.col(item)])
    parted = by_score.join(F.broadcast(sizes)).withColumn("part", F.when(F.col("rank") <= F.col("pool"), "hard").otherwise("easier")).drop("rank")
    drawn = running_totals(parted, ["part"], [F.col("_draw"), F.col(item)], {"_at": F.lit(1).cast("long")})
    wanted = F.when(F.col("part") == "hard", F.col("hard")).otherwise(F.col("budget") - F.col("hard"))
    return drawn.filter(F.col("_at") <= wanted).select(item, "part", "probability")


def folds_to_run(folds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Folds not yet done under the same settings."""
    return folds.join(ledger.select("fold", "settings").distinct(), ["fold", "settings"], "left_anti")


def sweep(masks: DataFrame, truth: Column, settings: dict[str, Column], *keys: str) -> DataFrame:
    """Every setting scored on every section in one pass over the pixels: ``(keys, setting, position, iou)``.

    The settings are columns of one aggregate, unpivoted afterwards, so the pixels are not multiplied by them.
    """
    parts = []
    for position, (name, claim) in enumerate(settings.items()):
        iou = F.count_if(claim & truth) / F.greatest(F.count_if(claim | truth), F.lit(1))
        parts.append(F.struct(F.lit(name).alias("setting"), F.lit(position).alias("position"), iou.alias("iou")).alias(f"_{position}"))
    made = masks.groupBy(*keys).agg(*parts)
    return made.select(*keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(settings))])))


def sweep_summary(swept: DataFrame, baseline: str) -> DataFrame:
    """Mean and median per setting and the mean gain over a fixed baseline setting."""
    made = swept.groupBy("setting").agg(F.avg("iou").alias("mean"), F.percentile("iou", 0.5).alias("median"), F.count("*").alias("n"))
    base = swept.filter(F.col("setting") == baseline).agg(F.avg("iou").alias("base"))
    return made.join(F.broadcast(base)).select("setting", "mean", "median", (F.col("mean") - F.col("base")).alias("gain"), "n")


def least_confident(cells: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """The model's own rows at or below their section's cut."""
    return cells.join(cuts, key).filter((F.col("source") == "model") & (F.col("probability") <= F.col("cut")))


def grade(masks: DataFrame, truth: Column, rules: dict) -> DataFrame:
    """Every rule graded by the same counts; a rule is a function that adds a boolean ``inside`` column."""
    out = None
    for name, rule in rules.items():
        made = rule(masks).groupBy("image").agg(F.lit(name).alias("rule"), F.count_if(truth & F.col("inside")).alias("both"), F.count_if("inside").alias("found"))
        out = made if out is None else out.unionByName(made)
    return out
