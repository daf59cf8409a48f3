"""Result tables: whole writes, one kept generation, upserts with a history, edit logs, exports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.scalars import density, region_rank


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def write_whole(df: DataFrame, path: str, keep_previous: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Write beside the target, then rename: no reader sees half a table; between the two renames there is none for a moment.

    With ``keep_previous`` the table about to be replaced stays as ``<path>.previous``, one generation deep. A plain write leaves
    the generation that an earlier write kept as it is.
    """
    spark = df.sparkSession
    fs, path_of = _fs(spark, path)
    staging, previous = f"{path}.partial", f"{path}.previous" if keep_previous else f"{path}.replaced"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    if fs.exists(path_of(path)):
        fs.delete(path_of(previous), True)
        fs.rename(path_of(path), path_of(previous))
    fs.rename(path_of(staging), path_of(path))
    if not keep_previous:
        fs.delete(path_of(previous), True)


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs, with ``surplus`` of the first table over the second."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags: per distinct row the two counts cancel. One aggregate over both sides, no row leaves the cluster."""
    return sorted(a.columns) == sorted(b.columns) and row_differences(a, b).isEmpty()


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Leave the table alone when it already says exactly this; returns whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path) and same_rows(df, spark.read.parquet(path)):
        return False
    write_whole(df, path)
    return True


def merge_run(existing: DataFrame, run: DataFrame, key: str = "image") -> DataFrame:
    """``run`` replaces its own images, every other row of ``existing`` stays as it is; missing columns become null.

    ``origin`` is ``kept`` or ``run``.
    """
    mine = run.select(key).distinct()
    return existing.join(mine, key, "left_anti").withColumn("origin", F.lit("kept")).unionByName(
        run.withColumn("origin", F.lit("run")), allowMissingColumns=True)


def merge_counts(existing: DataFrame, run: DataFrame, key: str = "image") -> DataFrame:
    """How many rows of the table stay and how many are replaced: one row ``(kept, replaced)``."""
    mine = run.select(key).distinct().withColumn("_in_run", F.lit(True))
    per_key = existing.groupBy(key).agg(F.count("*").alias("n")).join(mine, key, "left")
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("_in_run").isNull(), F.col("n"))), F.lit(0)).alias("kept"),
                       F.coalesce(F.sum(F.when(F.col("_in_run"), F.col("n"))), F.lit(0)).alias("replaced"))


def stamped(run: DataFrame, at: Column) -> DataFrame:
    """History rows: the run with one time for all of its rows."""
    return run.withColumn("counted_at", at)


def save_run(spark: SparkSession, run: DataFrame, path: str, history: str) -> tuple[int, int]:
    """Upsert the summary table and append to the history, which is never pruned; returns (kept, replaced)."""
    now = F.lit(datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0, tzinfo=None))
    existing = spark.read.parquet(path) if exists(spark, path) else run.limit(0)
    counts = merge_counts(existing, run).first()
    write_whole(merge_run(existing, run).drop("origin").orderBy("image", region_rank(F.col("region"))), path)
    stamped(run, now).write.mode("append").parquet(history)
    return counts["kept"], counts["replaced"]


def areas_in_order(areas: DataFrame) -> DataFrame:
    return areas.sortWithinPartitions("stem", region_rank(F.col("region")))


def write_areas(areas: DataFrame, path: str) -> None:
    """Area tables clustered on the section, rows in anatomical order inside it."""
    write_whole(areas.repartition("stem").transform(areas_in_order), path)


def edit_rows(added: DataFrame, removed: DataFrame, at: Column) -> DataFrame:
    """Log rows for cells added and removed."""
    columns = ("stem", "y", "x", "region", "probability")
    return added.select(*columns, F.lit("added").alias("action")).unionByName(
        removed.select(*columns, F.lit("removed").alias("action"))).withColumn("logged_at", at)


def summary_after_edits(summary: DataFrame, cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Summary rows of the edited images: ``classified`` and its density from the cells now there, ``detected`` untouched.

    ``cells(image, region)`` are all present cells, ``edits(image, region, action)`` what was added and removed. Images
    without edits keep their rows.
    """
    now = cells.groupBy("image", "region").agg(F.count("*").alias("_now"))
    moved = edits.groupBy("image", "region").agg(
        F.count_if(F.col("action") == "added").alias("_plus"), F.count_if(F.col("action") == "removed").alias("_minus"))
    edited = edits.select("image").distinct().withColumn("_edited", F.lit(True))
    joined = summary.join(now, ["image", "region"], "left").join(moved, ["image", "region"], "left").join(edited, "image", "left")
    fresh = F.coalesce("_now", F.lit(0))
    area_known = F.col("area_mm2").isNotNull() & (F.col("area_mm2") != 0)
    note = F.concat(F.lit("+"), F.coalesce("_plus", F.lit(0)).cast("string"), F.lit("-"), F.coalesce("_minus", F.lit(0)).cast("string"))
    return joined.select(
        "image", "region", "detected", F.when(F.col("_edited"), fresh).otherwise(F.col("classified")).alias("classified"), "area_mm2",
        F.when(F.col("_edited") & area_known, density(fresh, F.col("area_mm2"))).otherwise(F.col("density_per_mm2")).alias("density_per_mm2"),
        F.when(F.col("_edited"), note).alias("hand_edits"))


def vertex_provenance(saved: DataFrame, proposed: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Source of each saved polygon: ``model`` while its first shape equals the proposal vertex for vertex, else ``hand``.

    Shapes with fewer than three vertices are dropped; regions that were not shown are carried through. Equality is a
    comparison of counts on ``(vertex, y, x)``, so no polygon is gathered into one row.
    """
    keys = ["stem", "region"]
    mine = saved.filter("shape = 0").select(*keys, "vertex", "y", "x", F.lit(1).alias("s"), F.lit(0).alias("p"))
    theirs = proposed.select(*keys, "vertex", "y", "x", F.lit(0).alias("s"), F.lit(1).alias("p"))
    matched = mine.unionByName(theirs).groupBy(*keys, "vertex", "y", "x").agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    same = matched.groupBy(*keys).agg(F.bool_and(F.col("s") == F.col("p")).alias("same"))
    sizes = saved.groupBy(*keys, "shape").agg(F.count("*").alias("n")).filter("n >= 3")
    sources = sizes.join(same, keys, "left").select(
        *keys, "shape", F.when((F.col("shape") == 0) & F.coalesce("same", F.lit(False)), "model").otherwise("hand").alias("source"))
    out = saved.join(sources, [*keys, "shape"]).select(*keys, "shape", "vertex", "y", "x", "source")
    return out if carried is None else out.unionByName(carried.select(*out.columns))


def stale_areas(areas: DataFrame, outlines: DataFrame) -> DataFrame:
    """Sections whose area rows were made from another version of the outlines, or not at all: the work to do."""
    done = areas.select("stem", "version").distinct()
    return outlines.select("stem", "version").distinct().join(done, ["stem", "version"], "left_anti")


def export_text(frame: DataFrame, path: str, separator: str = "\t") -> None:
    """Delimited text with empty fields for missing numbers."""
    frame.write.mode("overwrite").option("header", True).option("sep", separator).option("nullValue", "").option("emptyValue", "").csv(path)


def export_line(frame: DataFrame, separator: str = "\t") -> Column:
    """The same line as one column, nulls as empty fields."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns]
    return F.concat_ws(separator, *fields)


def export_name(day: datetime.date) -> str:
    return f"cell counts {day.isoformat()}.csv"


def remembered(queue: DataFrame, folder: str | Column) -> DataFrame:
    """The stored work list of one folder ``(folder, position, stem, saved_at)``; another folder has none."""
    return queue.filter(F.col("folder") == folder).select("position", "stem", "saved_at")


def remember(spark: SparkSession, path: str, folder: str, stems: DataFrame) -> None:
    """Replace the work list of one folder; ``stems(position, stem)``. An empty list clears it."""
    fresh = stems.select(F.lit(folder).alias("folder"), "position", "stem", F.current_timestamp().alias("saved_at"))
    if exists(spark, path):
        fresh = spark.read.parquet(path).filter(F.col("folder") != folder).unionByName(fresh)
    write_whole(fresh, path)
