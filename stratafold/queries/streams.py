"""Registered queries: the stream operators in their batch form."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.plans import evaluation as ev
from stratafold.queries.aggregates import r
from stratafold.registry import query
from stratafold.session import shared_path
from stratafold.streaming import edits as st

C = F.col


@query("edit_log_batch_t1", "edits", "SELECT stem, y, x, action, logged_at, count(*) AS deliveries FROM (SELECT stem, y, x, action, date_trunc('hour', logged_at) AS logged_at FROM edits) GROUP BY ALL")
def edit_log_batch(spark, folder):
    """The log keyed as the stream keys it: repeated deliveries of one edit fall together."""
    e = fx.edits(spark, folder).withColumn("logged_at", F.date_trunc("hour", C("logged_at")).cast("timestamp_ntz"))
    return e.groupBy(*st.EDIT_KEY).agg(F.count("*").alias("deliveries"))


@query("streamed_edit_log_t1", "edits", "SELECT DISTINCT stem, y, x, action, logged_at FROM edits")
def streamed_edit_log(spark, folder):
    """A file stream of edits, a third of them delivered twice, through the log's stream; what the log then holds."""
    given, log = shared_path(spark, "edits"), shared_path(spark, "log")
    e = fx.edits(spark, folder).withColumn("logged_at", C("logged_at").cast("timestamp"))
    e.unionByName(e.filter("event_id % 3 = 0")).write.parquet(given)
    stream = spark.readStream.schema(e.schema).parquet(given)
    st.append_log(stream, log, shared_path(spark, "log-state")).awaitTermination()
    return spark.read.parquet(log).select("stem", "y", "x", "action", C("logged_at").cast("timestamp_ntz").alias("logged_at"))


@query("state_from_log_t1", "edits", "SELECT stem, y, x FROM edits GROUP BY 1, 2, 3 HAVING arg_max(action, (logged_at, event_id)) = 'added'")
def state_from_log(spark, folder):
    return st.latest_state(fx.edits(spark, folder))


@query("summary_batch_t2", "section_cells", """
WITH run AS (SELECT section_id AS image, region, weight % 3 AS batch, count(*) AS detected, max(logged_at) AS counted_at FROM section_cells GROUP BY 1, 2, 3), k AS (SELECT *, max(batch) OVER (PARTITION BY image) AS last FROM run)
SELECT image, region, detected, counted_at FROM k WHERE batch = last""")
def summary_batch(spark, folder):
    """Three runs merged in order: the last run of an image replaces all of its rows."""
    from stratafold.sources.sinks import merge_run

    runs = fx.section_cells(spark, folder).groupBy(C("section_id").alias("image"), "region", (C("weight") % 3).alias("batch")).agg(
        F.count("*").alias("detected"), F.max("logged_at").alias("counted_at"))
    table = runs.filter("batch = 0").drop("batch")
    for batch in (1, 2):
        table = merge_run(table, runs.filter(C("batch") == batch).drop("batch")).drop("origin")
    return table


@query("streamed_results_t3", "section_cells", "SELECT date_trunc('month', logged_at) AS seen, region, count(*) AS cells FROM section_cells GROUP BY 1, 2")
def streamed_results(spark, folder):
    """Results that arrive as files, taken up by the polling stream, then the table that it refreshes."""
    given, table = shared_path(spark, "results"), shared_path(spark, "polled")
    cells = fx.section_cells(spark, folder).select("logged_at", "region")
    cells.filter("region = 'CMM'").write.parquet(given)
    cells.filter("region <> 'CMM'").write.mode("append").parquet(given)
    rows, trigger = st.poll_results(spark, given, cells.schema, None)
    (rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", shared_path(spark, "polled-state")).trigger(**trigger).start().awaitTermination())
    seen = F.date_trunc("month", "logged_at").cast("timestamp_ntz").alias("seen")
    return spark.read.parquet(table).groupBy(seen, "region").agg(F.count("*").alias("cells"))


@query("polled_results_t3", "section_cells", "SELECT date_trunc('month', logged_at) AS seen, region, count(*) AS cells FROM section_cells GROUP BY 1, 2")
def polled_results(spark, folder):
    c = fx.section_cells(spark, folder)
    return c.groupBy(F.date_trunc("month", "logged_at").cast("timestamp_ntz").alias("seen"), "region").agg(F.count("*").alias("cells"))


@query("pluggable_rules_u1", "framed", """
SELECT image, 'line' AS rule, count(*) FILTER (lab = 1 AND tissue AND across > 0) AS both, count(*) FILTER (tissue AND across > 0) AS found FROM framed GROUP BY image
UNION ALL SELECT image, 'bright', count(*) FILTER (lab = 1 AND green > 0.1::DOUBLE), count(*) FILTER (green > 0.1::DOUBLE) FROM framed GROUP BY image""")
def pluggable_rules(spark, folder):
    """Rules are functions from frame to frame; one function grades them all."""
    rules = {"line": lambda f: f.withColumn("inside", C("tissue") & (C("across") > 0)), "bright": lambda f: f.withColumn("inside", C("green") > 0.1)}
    return ev.grade(fx.framed(spark, folder), C("lab") == 1, rules)


@query("pluggable_scorer_u2", "scored", "SELECT bird, round(avg(abs(probability - label)), 6) AS error, count(*) AS n FROM (SELECT bird, label, 1 - probability AS probability FROM scored) GROUP BY bird")
def pluggable_scorer(spark, folder):
    """A scorer is any function that adds a probability column."""
    scored = fx.scored(spark, folder).drop("probability").join(fx.scored(spark, folder).select("doc_id", C("probability").alias("_raw")), "doc_id")
    made = scored.transform(lambda f: f.withColumn("probability", 1 - C("_raw")))
    return made.groupBy("bird").agg(r(F.avg(F.abs(C("probability") - C("label"))), "error"), F.count("*").alias("n"))


@query("stage_trace_u3", "stops", """
WITH c AS (SELECT a.image, a.ray, min(b.stop + 2 * abs(a.ray - b.ray)) AS stop FROM stops a JOIN stops b ON b.image = a.image GROUP BY 1, 2) SELECT 'only' AS setting, 'clamp' AS stage, image, ray, stop FROM c
UNION ALL SELECT 'only', 'floor', image, ray, greatest(stop, 5) FROM c""")
def stage_trace(spark, folder):
    from stratafold.operators import borders
    from stratafold.plans.filling import staged

    stages = [("clamp", lambda b: borders.clamp(b, 2)), ("floor", lambda b: b.withColumn("stop", F.greatest("stop", F.lit(5))))]
    return staged(fx.stops(spark, folder), {"only": stages}).select("setting", "stage", "image", "ray", "stop")
