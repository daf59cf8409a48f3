"""What the corpus pipeline's stages do beside calling their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import near, suffix
from stratafold.llm.common import stored


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest ``doc_id``, a row without one last, then the smallest hash.

    A row is known by its id and its text, so two texts under one id are two documents, and rows without an id take part like any other.
    Rows that agree in both count as one, and one of them stays. Texts without words have no duplicates but themselves. An empty table
    stays empty. All columns are kept, whatever their names.
    """
    number = F.xxhash64(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))
    nodes = docs.select(number.alias("doc_id"), F.col("doc_id").cast("long").alias("id"), F.col("text"))
    groups = stored(near.near_duplicates(nodes.select("doc_id", "text"), n, percent).select("doc_id", "component_id").groupBy("doc_id").agg(
        F.min("component_id").alias("component"), F.count("*").alias("rows")), "groups")
    named = groups.join(nodes.select("doc_id", "id"), "doc_id")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"))
    kept = stored(groups.join(first.select("component", F.col("first.doc_id").alias("kept")), "component"), "kept")
    # both sides are few rows next to the texts, which stay where they are while these fit
    gone = kept.filter("doc_id <> kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, number == F.col("_gone"), "left_anti")
    several = kept.filter("doc_id = kept AND rows > 1").select(F.col("doc_id").alias("_several"))
    if several.isEmpty():
        return left
    again = left.join(several, number == F.col("_several"), "left_semi")
    once = again.withColumn("_node", number).dropDuplicates(["_node"]).select(*docs.columns) if "_node" not in docs.columns else again.dropDuplicates(["doc_id", "text"])
    return left.join(several, number == F.col("_several"), "left_anti").unionByName(once)


def without_passages(docs: DataFrame, span: int) -> DataFrame:
    """Texts without the passages of ``span`` bytes that occur in a document with a smaller id; documents of which nothing is left go.

    A null text stays null, an empty one empty. Rows with one id (or without one) are one document. An empty table stays empty.
    Characters go whole. ``n_chars``, where there is one, counts what is left.
    """
    found = suffix.without_earlier(docs, span=span, whole_characters=True).filter("_dedup_removed = 0 OR _dedup_removed < _dedup_bytes")
    made = found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("_dedup_kept").cast("string")))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)
