"""The corpus pipeline: documents are judged, freed of near-duplicates and of repeated passages, mixed and packed.

Each stage takes all documents that its predecessor kept, with the columns of ``documents``; the last one gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import mixing, packing, quality, stages
from stratafold.llm.common import bound_batches, stored, table

#: Words that near-duplicates' shingles have, and their similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Bytes of a passage that is kept only where it occurs first.
PASSAGE = 50
#: Weights of the sources in order of their names, the share of all words that the mix takes, and how often a document goes in at most.
WEIGHTS, SHARE, REPEATS = [3, 1, 2], 1.5, 2
LIMITS = packing.Limits(tokens=1024, segments=64, loss_tokens=1024)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    bound_batches(spark)
    return quality.judged(docs, table(spark, sf_dir, "labels"), seed=3).filter("_quality_kept").select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    bound_batches(spark)
    return stages.one_of_each(docs, SHINGLE, SIMILAR)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur in a document with a smaller id; documents of which nothing is left go."""
    bound_batches(spark)
    return stages.without_passages(docs, PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time that a document goes in, always whole."""
    return mixing.mixed_documents(
        docs, F.array("source"), mixing.word_count(F.col("text")), weights=WEIGHTS, share=SHARE, most=REPEATS, seed=11)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in the sequences."""
    bound_batches(spark)
    return packing.pack(docs, LIMITS, end_id=0)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", unlike),
    ("suffix-array dedup", without_passages),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor kept, written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
