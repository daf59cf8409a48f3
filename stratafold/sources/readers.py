"""Typed readers for the sidecar tables and the rules about what their rows mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.session import cut_lineage

SCHEMAS = {
    "regions": "region STRING, vertex BIGINT, y DOUBLE, x DOUBLE, source STRING",
    "counts": "y BIGINT, x BIGINT, region STRING, probability DOUBLE, source STRING",
    "areas": "region STRING, area_mm2 DOUBLE, tissue_px BIGINT",
    "edits": "logged_at TIMESTAMP, action STRING, y BIGINT, x BIGINT, region STRING, probability DOUBLE",
    "points": "seq BIGINT, y DOUBLE, x DOUBLE",
    "centers": "y DOUBLE, x DOUBLE, label INT",
    "cutoff": "index BIGINT, vertex BIGINT, y DOUBLE, x DOUBLE",
}


#: Names under which a column is found in a file's header, best first.
ALIASES = {"y": ("image-axis-0", "axis-0", "y"), "x": ("image-axis-1", "axis-1", "x")}
#: Columns that a file may leave out; the row's place in its file stands for the vertex number.
OPTIONAL = {"source", "vertex", "seq", "tissue_px", "label"}
_FIELD = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """The fields of a line. Only a line with a quote needs the pattern, which looks ahead to the line's end at every comma."""
    quoted = F.transform(F.split(line, _FIELD, -1), lambda f: F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _numbered(files: DataFrame, stem: Column) -> DataFrame:
    """``stem, line``, the line's place ``_place`` in its file and the file's first line as ``header``.

    A task reads blocks of files and numbers its lines as they come. The split into blocks is checkpointed, so that the blocks'
    totals, one row each, hold for the lines that they are joined to. No key has more lines than a block.
    """
    block = ["stem", "_file", "_block"]
    lines = cut_lineage(files.select(
        stem.alias("stem"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")))
    blocks = lines.groupBy(*block).agg(F.min("_at").alias("_from"), F.count("*").alias("_lines"), F.min_by("line", "_at").alias("_first"))
    order = Window.partitionBy("stem", "_file").orderBy("_block")
    before = F.coalesce(F.sum("_lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("stem").alias("_stem"), "_file", "_block", (before - F.col("_from")).alias("_shift"), F.first("_first").over(order).alias("_head"))
    blocks = blocks.withColumn("header", F.transform(_fields(F.regexp_replace("_head", "^\ufeff", "")), lambda c: F.trim(c)))
    return lines.join(blocks, ["_file", "_block"]).filter(F.col("stem").eqNullSafe(F.col("_stem"))).select("stem", "line", (F.col("_at") + F.col("_shift")).alias("_place"), "header")


def read_table(spark: SparkSession, kind: str, path: str, stem: Column | None = None) -> DataFrame:
    """A sidecar table with the stem of its file's name, the row's place ``row`` in the file, and what is wrong with it in ``problem``.

    Every file is read by its own header: columns in any order, with their other names, and without those that are optional. Files are
    read line by line, a large one by many tasks. No row is dropped: a field that cannot be read is null and named in ``problem``,
    which is null for a good row; ``good_rows`` refuses the others. No file, or an empty one, means no rows.
    """
    schema = T.StructType.fromDDL(SCHEMAS[kind])
    made = T.StructType([T.StructField("stem", T.StringType()), T.StructField("row", T.LongType()), *schema.fields, T.StructField("problem", T.StringType())])
    try:
        files = spark.read.text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], made)
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "([^/]+)$", 1)
    own = F.regexp_extract(name, r"^(.*?) [^/]*\.csv$", 1) if stem is None else stem
    rows = _numbered(files, own).filter((F.col("_place") > 0) & (F.trim("line") != ""))
    rows = rows.withColumn("fields", _fields(F.col("line"))).withColumn("row", F.col("_place") - 1)
    raws, absent, columns, problems = [], [], [], [F.when(F.col("_size") != F.col("_names"), F.concat(F.col("_size").cast("string"), F.lit(" fields under "), F.col("_names").cast("string"), F.lit(" names")))]
    for field in schema.fields:
        names = ALIASES.get(field.name, (field.name,))
        at = F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0)) for n in names])
        raws.append(F.nullif(F.trim(F.get("fields", (at - 1).cast("int"))), F.lit("")).alias(f"_raw_{field.name}"))
        absent.append(at.isNull().alias(f"_no_{field.name}"))
        raw, missing = F.col(f"_raw_{field.name}"), F.col(f"_no_{field.name}")
        value = raw.try_cast(field.dataType)
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):  # 5.0 is a whole number too
            number = raw.try_cast("double")
            value = F.coalesce(value, F.when(number == F.rint(number), number.cast(field.dataType)))
        if field.name in ("vertex", "seq"):
            value = F.when(missing, F.col("row")).otherwise(value)
        columns.append(value.alias(field.name))
        problems.append(F.when(raw.isNotNull() & F.col(field.name).isNull(), F.lit(f"{field.name} cannot be read")))
        if field.name not in OPTIONAL:
            problems.append(F.when(missing, F.lit(f"no column {field.name}")))
    # Each step is a projection of its own, so that a field is taken from its line, and read, once.
    rows = rows.select("stem", "row", F.size("fields").alias("_size"), F.size("header").alias("_names"), *raws, *absent)
    rows = rows.select("*", *columns)
    return rows.select("stem", "row", *[f.name for f in schema.fields], F.nullif(F.concat_ws("; ", *problems), F.lit("")).alias("problem"))


def good_rows(read: DataFrame) -> DataFrame:
    """The rows of a table that was read, failing on the first that has a problem."""
    text = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" beside "), F.col("stem"), F.lit(": "), F.col("problem"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(text).cast("string")).otherwise(F.col("stem"))
    return read.withColumn("stem", checked).drop("problem")


def with_source(cells: DataFrame) -> DataFrame:
    """A ``source`` column whether or not the table had one; cells without one are the model's."""
    known = F.coalesce(F.col("source"), F.lit("model")) if "source" in cells.columns else F.lit("model")
    return cells.withColumn("source", known)


def coordinates(table: DataFrame) -> DataFrame:
    """``y, x`` from whichever pair of column names is there: image-axis-0/1, axis-0/1, or y/x."""
    for a, b in (("image-axis-0", "image-axis-1"), ("axis-0", "axis-1"), ("y", "x")):
        if a in table.columns and b in table.columns:
            kept = [c for c in table.columns if c not in ("image-axis-0", "image-axis-1", "axis-0", "axis-1", "y", "x")]
            return table.select(*kept, F.col(f"`{a}`").cast("double").alias("y"), F.col(f"`{b}`").cast("double").alias("x"))
    raise ValueError(f"no coordinates among {table.columns}")


def first_point(points: DataFrame, *keys: str) -> DataFrame:
    """The first click of each group."""
    return points.groupBy(*keys).agg(F.min_by(F.struct("y", "x"), "seq").alias("p")).select(*keys, "p.y", "p.x")


def first_two_points(points: DataFrame, *keys: str) -> DataFrame:
    """The first two clicks as one row; groups with fewer are absent. Two mergeable aggregates, so no group is gathered."""
    first = points.groupBy(*keys).agg(F.min_by(F.struct("seq", "y", "x"), "seq").alias("a"))
    rest = points.join(first, list(keys)).filter(F.col("seq") > F.col("a.seq"))
    return rest.groupBy(*keys).agg(F.first("a").alias("a"), F.min_by(F.struct("y", "x"), "seq").alias("b")).select(
        *keys, F.col("a.y").alias("y1"), F.col("a.x").alias("x1"), F.col("b.y").alias("y2"), F.col("b.x").alias("x2"))


def prefer(primary: DataFrame, secondary: DataFrame, key: str, labels: tuple[str, str] = ("counted", "hand")) -> DataFrame:
    """Rows of ``primary`` where a key has any, else those of ``secondary``; ``used`` says which.

    The keys of the primary side are aggregated first, so the anti join carries one row per key.
    """
    have = primary.select(key).distinct()
    return primary.withColumn("used", F.lit(labels[0])).unionByName(
        secondary.join(have, key, "left_anti").withColumn("used", F.lit(labels[1])))


def raster_green(raw: DataFrame, limit: float | Column = 255.0) -> DataFrame:
    """Channel 1 of a pixel table ``(.., c, v)`` scaled to 0-1; one-channel images keep channel 0, two channels are an error.

    The number of channels is a property of the image, so it is an aggregate joined back on the image key.
    """
    top = raw.groupBy("image").agg(F.max("c").alias("top"))
    scale = limit if isinstance(limit, Column) else F.lit(float(limit))
    refused = F.raise_error(F.concat(F.lit("image "), F.col("image").cast("string"), F.lit(" has two channels; one or at least three are needed")))
    return raw.join(top, "image").filter(F.col("c") == F.least("top", F.lit(1))).select(
        "image", "y", "x", F.when(F.col("top") == 1, refused.cast("double")).otherwise(F.col("v") / scale).alias("green"))


def label_outlines(vertices: DataFrame) -> DataFrame:
    """Outlines fit for use as labels: rows still marked as the model's own proposal are left out."""
    return vertices.filter(F.coalesce(F.col("source"), F.lit("hand")) != "model")
