"""Catalog of image files and the sidecar tables beside them, from a listing of ``(path, modified)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.constants import IMAGE_SUFFIXES, SIDECAR_SUFFIXES, SKIP_FOLDERS
from stratafold.functions.scalars import status


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing; ``content`` is never selected, so no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"))


def in_skipped_folder(path: Column) -> Column:
    """Any parent folder in the fixed skip set or starting with a dot."""
    parts = F.split(path, "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(parents, lambda part: part.isin(*SKIP_FOLDERS) | part.startswith("."))


def folder_of(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def image_files(listing: DataFrame) -> DataFrame:
    """Image files outside skipped folders, with their stem."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return listing.filter(suffix.isin(*IMAGE_SUFFIXES) & ~in_skipped_folder(F.col("path"))).withColumn(
        "stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def resolve_images(listing: DataFrame) -> DataFrame:
    """One row per stem: the shallowest path, ties by lower-cased path. A partial aggregate, so no stem is gathered."""
    order = F.struct(F.size(F.split("path", "/")), F.lower("path"), F.col("path"))
    return image_files(listing).groupBy("stem").agg(
        F.min_by(F.struct("path", "modified"), order).alias("w"), (F.count("*") - 1).alias("duplicates")).select(
        "stem", "w.path", "w.modified", "duplicates")


def duplicate_images(listing: DataFrame) -> DataFrame:
    """The losers of ``resolve_images`` with the path that was used instead."""
    winners = resolve_images(listing).filter("duplicates > 0").select("stem", F.col("path").alias("winner"))
    return image_files(listing).join(winners, "stem").filter("path <> winner").select(F.col("path").alias("loser"), "winner")


def sidecar_files(listing: DataFrame) -> DataFrame:
    """``(folder, stem, kind, modified)`` of every sidecar table, read back from its name."""
    kinds = F.create_map(*[F.lit(v) for word, suffix in SIDECAR_SUFFIXES.items() for v in (suffix, word)])
    pattern = "^(.+?)(" + "|".join(suffix.replace(".", "[.]") for suffix in SIDECAR_SUFFIXES.values()) + ")$"
    tables = listing.filter(F.col("path").endswith(".csv")).withColumn("_name", F.substring_index("path", "/", -1)).withColumn(
        "_suffix", F.regexp_extract("_name", pattern, 2)).filter("_suffix <> ''")
    stem = F.substr("_name", F.lit(1), F.length("_name") - F.length("_suffix"))
    return tables.select(folder_of(F.col("path")).alias("folder"), stem.alias("stem"), F.element_at(kinds, F.col("_suffix")).alias("kind"), "modified")


def section_table(listing: DataFrame) -> DataFrame:
    """Every section with the three existence flags, its status and whether its counts are older than its outlines.

    Sidecars count when they lie beside the image. Images and sidecars meet in one aggregate on (folder, stem) - one shuffle, no join.
    """
    images = resolve_images(listing).select(folder_of(F.col("path")).alias("folder"), "stem", F.lit("image").alias("kind"), "path", "modified")
    both = images.unionByName(sidecar_files(listing), allowMissingColumns=True)
    made = both.groupBy("folder", "stem").agg(
        F.max("path").alias("path"), *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(f"has_{k}") for k in ("regions", "dorsal", "counts")],
        F.max(F.when(F.col("kind") == "regions", F.col("modified"))).alias("regions_at"),
        F.max(F.when(F.col("kind") == "counts", F.col("modified"))).alias("counts_at"))
    return made.filter("path IS NOT NULL").select(
        "stem", "path", "has_regions", "has_dorsal", "has_counts",
        status(F.col("has_regions"), F.col("has_dorsal"), F.col("has_counts")).alias("status"),
        F.coalesce(F.col("regions_at") > F.col("counts_at"), F.lit(False)).alias("stale"))


def resolve_fragments(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """``wanted(fragment)`` to the one section it names: an exact stem wins, else a fragment found in exactly one stem.

    Exact names are an equality join. The rest meet the stems' substrings by equality as well - of the lengths that are asked for,
    each distinct one counted once with its stems - so no fragment is compared with every stem. The planner takes the substrings
    for as small as the stems, so their join is held to a shuffle; by their guessed size they would go through the driver.
    """
    asked = wanted.select("fragment").distinct()
    exact = asked.join(sections.select(F.col("stem").alias("fragment"), F.col("stem")).distinct(), "fragment")
    rest = asked.join(exact.select("fragment"), "fragment", "left_anti").withColumn("piece", F.lower("fragment"))
    lengths = rest.agg(F.collect_set(F.length("piece")).alias("_lengths"))  # one row, no longer than the longest name
    stems = sections.select("stem").distinct().withColumn("name", F.lower("stem"))
    spread = F.array_distinct(F.flatten(F.transform(
        F.filter("_lengths", lambda n: n <= F.length("name")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda at: F.substr("name", at, n)))))
    pieces = stems.crossJoin(F.broadcast(lengths)).select("stem", F.explode(spread).alias("piece"))
    named = pieces.groupBy("piece").agg(F.count("stem").alias("matches"), F.min("stem").alias("stem"))
    partial = rest.join(named.hint("merge"), "piece", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return exact.select("fragment", F.lit(1).cast("long").alias("matches"), "stem").unionByName(
        partial.select("fragment", "matches", F.when(F.col("matches") == 1, F.col("stem")).alias("stem")))


def one_table_per_stem(listing: DataFrame, kind: str = "regions") -> DataFrame:
    """One sidecar folder per stem; the copy beside the section's own image is preferred, then the first by name."""
    own = resolve_images(listing).select("stem", folder_of(F.col("path")).alias("home"))
    return sidecar_files(listing).filter(F.col("kind") == kind).join(own, "stem").groupBy("stem").agg(
        F.min(F.struct((F.col("folder") != F.col("home")).alias("away"), F.col("folder"))).alias("b"), F.count("*").alias("copies")).select(
        "stem", "b.folder", "copies")


def folder_report(listing: DataFrame) -> DataFrame:
    """Distinct sections, repeated names and folders that hold images."""
    found = image_files(listing).select("stem", folder_of(F.col("path")).alias("folder"))
    return found.agg(F.count_distinct("stem").alias("images"), (F.count("*") - F.count_distinct("stem")).alias("duplicates"), F.count_distinct("folder").alias("folders"))
