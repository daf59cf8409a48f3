"""Streams: the edit log, the summary table kept up to date run by run, and the polled refresh of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratafold.sources.sinks import exists, merge_run, stamped, write_whole

EDIT_KEY = ["stem", "y", "x", "action", "logged_at"]


def deduplicated(edits: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of one edit are dropped while the watermark still knows them; state is bounded by the lateness."""
    return edits.withWatermark("logged_at", lateness).dropDuplicatesWithinWatermark(EDIT_KEY)


def append_log(edits: DataFrame, path: str, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
    """Append-only edit log; ends when everything available has been read."""
    return (deduplicated(edits, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def upsert_batch(spark: SparkSession, runs: DataFrame, batch_id: int, path: str, history: str) -> None:
    """One micro-batch of finished runs into the summary; a batch that is delivered again changes nothing.

    The history is partitioned by batch and that partition is overwritten. Of several rows for one image and region in the
    batch the newest wins, by a mergeable aggregate.
    """
    columns = [c for c in runs.columns if c not in ("image", "region")]
    latest = runs.groupBy("image", "region").agg(F.max_by(F.struct(*columns), "counted_at").alias("_r")).select("image", "region", "_r.*")
    stamped(latest, F.col("counted_at")).write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
    if exists(spark, path):
        latest = merge_run(spark.read.parquet(path), latest).drop("origin")
    write_whole(latest, path)


def keep_summary(runs: DataFrame, path: str, history: str, checkpoint: str) -> StreamingQuery:
    """Summary upsert and history append for a stream of finished runs."""
    spark = runs.sparkSession
    return (runs.writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(spark, batch, batch_id, path, history))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def poll_results(spark: SparkSession, folder: str, schema: str, every: str | None = "15 seconds"):
    """A file stream over new result tables and the trigger that polls it; without a period it reads what is there and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return spark.readStream.schema(schema).parquet(folder), trigger


def latest_state(edits: DataFrame) -> DataFrame:
    """What the log says now: a pixel is present when its newest entry added it."""
    return edits.groupBy("stem", "y", "x").agg(F.max_by("action", F.struct("logged_at", "event_id")).alias("action")).filter("action = 'added'").select("stem", "y", "x")
