"""Batch tables: what is ready to be counted, what is left out and why, and what a job ledger says is under way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import ALREADY_QUEUED, ALREADY_RUNNING, COUNTED_SINCE, COUNTING_NOW, COUNTING_OUTSIDE, GONE
from stratafold.functions.scalars import first_reason, newer, reason_to_skip


def flagged(sections: DataFrame, stems: DataFrame, name: str) -> DataFrame:
    """A boolean column telling whether the stem is in the other table."""
    marks = stems.select("stem").distinct().withColumn(name, F.lit(True))
    return sections.join(marks, "stem", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def batch(sections: DataFrame, running: DataFrame, queued: DataFrame, outside: DataFrame) -> DataFrame:
    """Every section with the reason it is left out, null when it is to be counted; structural reasons come first."""
    marked = sections
    for stems, name in ((running, "is_running"), (queued, "is_queued"), (outside, "is_outside")):
        marked = flagged(marked, stems, name)
    return marked.withColumn("reason", F.coalesce(
        reason_to_skip(F.col("has_regions"), F.col("has_dorsal")),
        first_reason((F.col("is_running"), ALREADY_RUNNING), (F.col("is_queued"), ALREADY_QUEUED), (F.col("is_outside"), COUNTING_OUTSIDE))))


def restorable(queue: DataFrame, sections: DataFrame, outside: DataFrame) -> DataFrame:
    """A remembered work list against the sections there now: the reason each stem is dropped, null when it is offered again.

    ``queue(position, stem, saved_at)`` keeps its own order through ``position``.
    """
    here = sections.select("stem", "has_regions", "has_dorsal", "counts_mtime", F.lit(True).alias("_here"))
    joined = flagged(queue.join(here, "stem", "left"), outside, "is_outside")
    reason: Column = F.coalesce(
        first_reason((F.col("_here").isNull(), GONE), (F.col("is_outside"), COUNTING_NOW),
                     (newer(F.col("counts_mtime"), F.col("saved_at")), COUNTED_SINCE)),
        reason_to_skip(F.coalesce("has_regions", F.lit(False)), F.coalesce("has_dorsal", F.lit(False))))
    return joined.select("position", "stem", reason.alias("reason"))


def jobs_by_section(sections: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first job of a ledger ``(seq, pid, minutes, command)`` whose command names the section's image file.

    Commands are cut into words, so the file name is met by equality instead of a containment test against every section.
    """
    words = ledger.select("seq", "pid", "minutes", F.explode(F.array_distinct(F.split("command", r"[\s/\"']+"))).alias("file"))
    return sections.join(words, "file").groupBy("stem").agg(F.min_by(F.struct("pid", "minutes"), "seq").alias("j")).select("stem", "j.pid", "j.minutes")
