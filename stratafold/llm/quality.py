"""Quality by importance resampling: the ratio of two hashed n-gram models, drawn from by Gumbel top-k.

Both models count tokens (letters, digits and signs apart) and pairs of tokens, a pair of equal tokens as one sign of repetition,
in ``BUCKETS`` hashed buckets. The raw model counts all documents; the target model counts those documents of a bounded sample of
labels (``MOST_LABELS``) that are good. A document's weight is its mean log ratio of target to raw, on the scale of a document of
``SCALE`` n-grams, and its key is that weight plus a Gumbel variate from a hash of its id and text. The documents with the k
largest keys are a sample without replacement by importance; here k is the number of documents whose weight is at least the one
that parts good from bad best among sampled labels that the target model has not seen. The k-th key is found by counting bins,
in passes over the documents; rows with equal keys, which are repeats of one row, share one fate.

Nulls and empty texts have no n-grams and the weight 0. Null labels are ignored; repeated labels count as their largest values.
Without good and bad labels nothing is rejected. An empty table gives no rows. Extra columns are carried along; ``_quality`` names
are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.llm.common import mixed, one_by_one, stored, utf8
from stratafold.llm.tokens import forget
from stratafold.llm.words import slices, word_hashes

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
SCALE = 128.0
MOST_LABELS = 20_000
SMOOTHING = 1.0
#: Bins of one counting pass, and rows of a bin that are fetched.
BINS = 1024
FETCHED = 10_000


def buckets(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram."""
    docs, words = word_hashes(data, limits, by_kind=True)
    if not len(words):
        return docs, np.zeros(0, np.int64)
    same = docs[1:] == docs[:-1]
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), pairs)
    both = np.concatenate([words, pairs[same]]) >> np.uint64(64 - BUCKETS_LOG2)
    return np.concatenate([docs, docs[:-1][same]]), both.astype(np.int64)


def label_sample(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """At most ``most`` rows ``_quality_id, _quality_good, _quality_fit``; one half fits the target, the other half is held out."""
    each = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_quality_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_q"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("_t"))
    h = F.xxhash64(F.lit("labels"), "_quality_id")
    picked = each.withColumn("_h", h).orderBy("_h", "_quality_id").limit(most)
    return picked.select("_quality_id", F.when(F.col("_q") == 0, 0).when(F.col("_t") == 0, 1).alias("_quality_good"), (F.col("_h") % 2 == 0).alias("_quality_fit"))


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability per bucket; ``BUCKETS`` numbers reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_quality_id"), "left")
    rows = rows.select("text", (F.coalesce(F.col("_quality_fit") & (F.col("_quality_good") == 1), F.lit(False))).alias("target"))

    def count(batches):
        forget()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in one_by_one(batches):
            data, limits = utf8(batch["text"])
            good = batch["target"].to_numpy(zero_copy_only=False)
            for a, b in slices(limits):
                doc, bucket = buckets(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[a + doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    part = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return part(target) - part(raw)


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """``docs`` with ``_quality_weight``, ``_quality_grams`` and ``_quality_key``."""
    text = docs.schema.fieldNames().index("text")
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema], T.StructField("_quality_weight", T.DoubleType()), T.StructField("_quality_grams", T.LongType())])

    def weigh(batches):
        forget()
        for batch in one_by_one(batches):
            data, limits = utf8(batch.column(text))
            total, grams = np.zeros(len(limits) - 1), np.zeros(len(limits) - 1, np.int64)
            for a, b in slices(limits):
                doc, bucket = buckets(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a])
                total[a:b] = np.bincount(doc, ratios[bucket], b - a)
                grams[a:b] = np.bincount(doc, minlength=b - a)
            weight = SCALE * total / np.maximum(grams, 1)
            yield pa.record_batch([*batch.columns, pa.array(weight), pa.array(grams)], names=[*batch.schema.names, "_quality_weight", "_quality_grams"])

    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    even = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return docs.mapInArrow(weigh, out).withColumn("_quality_key", F.col("_quality_weight") - F.log(-F.log(even)))


def best_part(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad with the fewest mistakes by share; in the middle of the widest such gap."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / max(g.sum(), 1)
    let_in = 1 - np.concatenate([[0], np.cumsum(~g)]) / max((~g).sum(), 1)
    wrong = lost + let_in
    edge = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    gap = np.where(wrong <= wrong.min() + 1e-12, np.diff(edge), -1)
    i = int(np.argmax(gap))
    return float((edge[i] + edge[i + 1]) / 2)


def kth_largest(df: DataFrame, key: Column, k: int) -> float | None:
    """The exact k-th largest key, by counting bins of what is left until few rows, or equal ones, remain; None if there are fewer."""
    keys = df.select(key.alias("k"))
    low, high = -float("inf"), float("inf")
    while True:
        part = keys.filter((F.col("k") >= low) & (F.col("k") <= high))
        lo, hi, n = part.agg(F.min("k"), F.max("k"), F.count("*")).first()
        if n < k:
            return None
        if lo == hi:
            return lo
        if n <= FETCHED:
            return sorted((r["k"] for r in part.collect()), reverse=True)[k - 1]
        width = (hi - lo) / BINS
        number = F.least(F.floor((F.col("k") - lo) / width), F.lit(BINS - 1)).cast("int")
        counts = {r["b"]: r for r in part.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b]["n"] >= k:
                low, high = counts[b]["lo"], counts[b]["hi"]
                break
            k -= counts[b]["n"]


def judged(docs: DataFrame, labels: DataFrame, seed: int = 0, most_labels: int = MOST_LABELS) -> DataFrame:
    """``docs`` with ``_quality_weight``, ``_quality_grams``, ``_quality_key`` and ``_quality_kept``."""
    sample = stored(label_sample(labels, most_labels), "labels")
    ratios = log_ratios(docs, sample)
    unseen = F.broadcast(sample.filter("NOT _quality_fit AND _quality_good IS NOT NULL"))
    held = weighed(docs.join(unseen, F.col("doc_id").cast("long") == F.col("_quality_id")), ratios, seed)
    seen = held.dropDuplicates(["_quality_id"]).select("_quality_weight", "_quality_good").collect()  # a part of the label sample
    good = np.array([r["_quality_good"] == 1 for r in seen], bool)
    scored = weighed(docs, ratios, seed)
    if not len(seen) or good.all() or not good.any():
        return scored.withColumn("_quality_kept", F.lit(True))
    part = best_part(np.array([r["_quality_weight"] for r in seen]), good)
    keys = stored(scored.select("_quality_weight", "_quality_key"), "keys")
    k = keys.filter(F.col("_quality_weight") >= part).count()
    least = kth_largest(keys, F.col("_quality_key"), k) if k else None
    return scored.withColumn("_quality_kept", F.col("_quality_key") >= (float("inf") if least is None else least))
