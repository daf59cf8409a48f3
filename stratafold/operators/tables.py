"""The numbers table and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import REGION_NAMES, STALE_MARK
from stratafold.functions.scalars import bird_of, density, newer, region_rank, status


def numbers_table(sections: DataFrame, cells: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per section and region: count, area, density, stale. Uncounted sections have null counts, counted ones zeros.

    ``sections(section_id, stem, has_*, regions_mtime)``, ``cells(section_id, region, logged_at)``, ``areas(section_id, region,
    area_mm2)``. The region list is fixed, so counts and areas are one array per section, made by a single aggregate with
    map-side combine; everything meets on section_id and the regions are exploded at the end, after the joins.
    """
    def per_region(value):
        return F.array(*[value(F.col("region") == name) for name in REGION_NAMES])

    tallies = cells.groupBy("section_id").agg(per_region(F.count_if).alias("counts"), F.max("logged_at").alias("counts_mtime"))
    sizes = areas.groupBy("section_id").agg(per_region(lambda mine: F.max(F.when(mine, F.col("area_mm2")))).alias("sizes"))
    regions = F.array(*[F.lit(name) for name in REGION_NAMES])
    joined = sections.join(tallies, "section_id", "left").join(sizes, "section_id", "left").select("*", F.posexplode(regions).alias("pos", "region"))
    cells_now = F.when(F.col("has_counts"), F.coalesce(F.get("counts", "pos"), F.lit(0)))
    area = F.get("sizes", "pos")
    return joined.select(
        "section_id", "stem", bird_of(F.col("stem")).alias("bird"), "region",
        status(F.col("has_regions"), F.col("has_dorsal"), F.col("has_counts")).alias("status"), cells_now.alias("cells"), area.alias("area_mm2"),
        density(cells_now, area).alias("density_per_mm2"),
        (F.col("has_counts") & F.col("has_regions") & newer(F.col("regions_mtime"), F.col("counts_mtime"))).alias("stale"))


def usable(table: DataFrame) -> DataFrame:
    return table.filter(F.col("density_per_mm2").isNotNull() & ~F.col("stale"))


def by_region(table: DataFrame) -> DataFrame:
    """Count, mean and spread of the densities per region over rows that are up to date."""
    return usable(table).groupBy("region").agg(
        F.count("density_per_mm2").alias("n"), F.avg("density_per_mm2").alias("mean"), F.stddev_samp("density_per_mm2").alias("sd"))


def by_bird(table: DataFrame) -> DataFrame:
    """Per bird and region: sections, mean density, sd (null for one section), mean area. Counts are never summed."""
    return usable(table).groupBy("bird", "region").agg(
        F.count("density_per_mm2").alias("sections"), F.bround(F.avg("density_per_mm2"), 1).alias("mean_cells_per_mm2"),
        F.bround(F.stddev_samp("density_per_mm2"), 1).alias("sd"), F.bround(F.avg("area_mm2"), 4).alias("mean_area_mm2"))


def in_reading_order(table: DataFrame, *columns: str) -> DataFrame:
    return table.orderBy(*columns, region_rank(F.col("region")))


def for_export(table: DataFrame) -> DataFrame:
    """Counted rows with spreadsheet names; stale ones are marked, not dropped."""
    return table.filter("cells IS NOT NULL").select(
        "bird", F.col("stem").alias("section"), "region", F.col("cells").cast("long").alias("cells"), F.col("area_mm2").alias("area mm2"),
        F.col("density_per_mm2").alias("cells per mm2"), F.when(F.col("stale"), STALE_MARK).otherwise("").alias("stale"))


def export_summary(export: DataFrame) -> DataFrame:
    """Rows, stale rows, sections and birds of an export."""
    return export.agg(F.count("*").alias("rows"), F.count_if(F.col("stale") != "").alias("stale_rows"),
                      F.count_distinct("section").alias("sections"), F.count_distinct("bird").alias("birds"))


def bird_summary(table: DataFrame, frame: DataFrame) -> DataFrame:
    """What the per-bird view is built from and how many stale rows were left out."""
    dropped = table.agg(F.count_if(F.col("cells").isNotNull() & F.col("stale")).alias("dropped"))
    made = frame.agg(F.count("*").alias("rows"), F.count_distinct("bird").alias("birds"), F.max("sections").alias("most_sections"))
    return made.crossJoin(F.broadcast(dropped))  # two single rows


def section_results(candidates: DataFrame, areas: DataFrame, threshold: float) -> DataFrame:
    """Result row per section and region: detected, classified, area and both densities."""
    n = candidates.groupBy("section_id", "region").agg(
        F.count("*").alias("detected"), F.count_if(F.col("probability") >= threshold).alias("classified"))
    zero = F.lit(0)
    return areas.join(n, ["section_id", "region"], "left").select(
        "section_id", "region", F.coalesce("detected", zero).alias("detected"), F.coalesce("classified", zero).alias("classified"),
        "tissue_px", F.lit(threshold).alias("threshold"), "area_mm2", density(F.coalesce("classified", zero), F.col("area_mm2")).alias("density_per_mm2"),
        density(F.coalesce("detected", zero), F.col("area_mm2")).alias("detected_density_per_mm2"))


def note(status_col: Column, stale: Column) -> Column:
    """The note beside a section's block of numbers."""
    return F.when(stale, "recount: outlines are newer than the count").when(status_col != "counted", status_col).otherwise("")
