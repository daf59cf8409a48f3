"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot is an anchor followed by a chain of content words: the two content words after it, where the first stands right behind it.
Anchors are common words, and the places where a text, a line, a sentence or a cell of a table begins, so lists and short texts
have spots too. A document's fingerprint is the set of its spots' hashes, written in order. A text without content words uses its
own hash; equal texts always have equal fingerprints. Sets are likened by Jaccard; with a least likeness, sets
are put into classes of length in such a way that alike sets are in the same class or the next one, and all others are pruned.

Nulls: a null text is empty; a null ``doc_id`` comes last, as the smallest long does, which is read as null. Rows that repeat id and text share one place in the order of documents.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import stored

#: Common words of the corpus's languages; a parameter.
COMMON = tuple(
    "the of and to in is a that it for on with as was be by at this are or an from not "
    "de la le et les des un une du en que qui est pour dans sur par au avec "
    "der die und das den von zu mit sich ist im dem nicht ein eine auf für "
    "el los las y del se por con para su al lo como más o esta".split()
)


#: Stands for the beginning of a text, line, sentence or cell.
STOP = "\u00a7"


def with_spots(df: DataFrame, text: str, name: str, common: tuple[str, ...] = COMMON) -> DataFrame:
    """Adds ``name``: the sorted set of the spots' hashes of the text column."""
    words, chain = f"_w_{name}", f"_c_{name}"
    stopped = F.regexp_replace(F.lower(F.concat(F.lit("."), F.coalesce(text, F.lit("")))), r"[\n|.!?;:]+", f" {STOP} ")
    df = df.withColumn(words, F.split(stopped, rf"[^\p{{L}}\p{{N}}{STOP}]+"))
    # a content word with the anchor right before it, null where there is none
    anchors = (STOP, *common)
    marked = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(F.get(words, i - 1).isin(*anchors), F.get(words, i - 1)).alias("a")))
    df = df.withColumn(chain, F.filter(marked, lambda m: ~m["w"].isin("", *anchors)))
    spots = F.transform(chain, lambda m, i: F.when(m["a"].isNotNull(), F.hash(m["a"], m["w"], F.get(chain, i + 1)["w"])))
    df = df.withColumn(name, F.array_compact(spots))
    found = F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.hash(F.coalesce(text, F.lit("")))))
    return df.withColumn(name, F.sort_array(F.array_distinct(found))).drop(words, chain)


def fingerprint(spots: Column) -> Column:
    return F.array_join(spots.cast("array<string>"), ",")


def length_class(spots: Column, least: float) -> Column:
    """Class of the set's length; sets with a Jaccard of ``least`` or more are at most one class apart."""
    return F.floor(F.log(F.size(spots).cast("double")) / F.lit(-math.log(least))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; with ``least``, 0 for sets whose lengths alone rule that likeness out."""
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    if not least:
        return exact
    near = F.abs(length_class(a, least) - length_class(b, least)) <= 1
    return F.when(near & (F.least(F.size(a), F.size(b)) >= F.lit(least) * F.greatest(F.size(a), F.size(b))), exact).otherwise(0.0)


def next_in_order(keys: DataFrame) -> DataFrame:
    """Adds ``next_id, next_h``: the next key in descending order of ``_id, _h``; the first follows the last.

    The keys are range-partitioned and that placement is stored; a window covers one part, and one row per part links the parts.
    """
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // 500_000))
    order = [F.col("_id").desc(), F.col("_h")]
    placed = stored(keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("_part").orderBy(*order)
    led = placed.withColumn("_row", F.row_number().over(inside)).withColumn("_next", F.lead(F.struct("_id", "_h")).over(inside))
    heads = led.filter("_row = 1").select("_part", F.struct("_id", "_h").alias("_head"))
    ring = Window.orderBy("_part")  # a row per part
    first = F.first("_head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(ring), first).alias("_after"))
    both = led.join(heads, "_part").withColumn("_next", F.coalesce("_next", "_after"))
    return both.select(*keys.columns, F.col("_next._id").alias("next_id"), F.col("_next._h").alias("next_h"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, whose last third is the beginning of the next document.

    A document travels to its predecessor as its first third and its spots, not as its whole text.
    """
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.lit(-(1 << 63))
    # both joins read these very columns, so their one shuffle serves both
    rows = docs.select(F.coalesce(doc_id, none).alias("_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    keys = rows.groupBy("_id", "_h").agg(F.floor(F.max(F.length("text")) / 3).cast("int").alias("_third"))
    ring = next_in_order(keys).toDF("_to", "_to_h", "_third", "_id", "_h")
    ahead = with_spots(rows.join(ring, ["_id", "_h"]), "text", "_next_spots")
    ahead = ahead.select(F.col("_to").alias("_id"), F.col("_to_h").alias("_h"), F.struct(
        F.substring(F.col("text"), F.lit(1), F.col("_third")).alias("head"), F.col("_next_spots").alias("spots")).alias("_n"))
    ahead = ahead.groupBy("_id", "_h").agg(F.first("_n").alias("_n"))  # repeats of the next row are alike
    both = rows.join(ahead, ["_id", "_h"])
    length = F.length("text")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), length - F.floor(length / 3).cast("int")), F.col("_n.head")))
    both = with_spots(with_spots(both, "text", "spots"), "edited", "edited_spots")
    return both.select(
        F.nullif(F.col("_id"), none).alias("doc_id"), length.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("_n.spots")).alias("near_next"))
