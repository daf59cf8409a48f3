"""A global shuffle into shards in two passes over external buckets.

Pass one scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash of their content. Pass two
reads one bucket at a time, puts it into a canonical order, permutes it with a Fisher-Yates shuffle seeded by the bucket and
writes it. The permuted buckets, in order of their number, are one random order of all records; record ``p`` of it goes to shard
``p mod shards`` at slot ``p div shards``, so the shards' counts are at most one apart and slots have no gaps. The number of
records in the buckets before travels with each bucket as a row of its own, so no join is needed.

A record that is repeated so often that it would fill a bucket is counted instead, and its repeats are numbered and scattered by
their number too. So a record's bucket depends on nothing but the table, the seed and the size of the buckets. Nulls hash like any value; a null text has no bytes. An empty table gives no rows. Extra
columns are carried along; only names that begin with ``_shuffle`` are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.llm.common import parts_for

BUCKET_BYTES = 16 << 20
#: A bucket may hold this share of repeats of one record before they are scattered one by one.
HOT_SHARE = 1 / 8


def permuted(rows: pa.Table, seed: int, bucket: int) -> pa.Table:
    """The bucket in the order of a seeded Fisher-Yates shuffle."""
    draw = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket]))
    order = np.arange(rows.num_rows)
    draw.shuffle(order)  # NumPy's shuffle is Fisher and Yates's
    return rows.take(pa.array(order))


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, in the order in which each task writes them."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    named = [F.col(f"`{c}`") for c in columns]
    buckets = parts_for(docs, "text", bucket_bytes)
    hashed = docs.select(*named, F.xxhash64(F.lit(seed), "doc_id", "text").alias("_shuffle_key"))
    keys = hashed.select("_shuffle_key")
    # at most buckets / HOT_SHARE rows: each stands for that share of a bucket's records
    most = F.lit(max(1, int(docs.count() / buckets * HOT_SHARE)))
    hot = keys.groupBy("_shuffle_key").count().filter(F.col("count") > most).select("_shuffle_key")
    cold = hashed.join(F.broadcast(hot), "_shuffle_key", "left_anti").withColumn("_shuffle_row", F.lit(0))
    counted = hashed.join(F.broadcast(hot), "_shuffle_key", "left_semi").groupBy(*named, "_shuffle_key").agg(F.count("*").cast("int").alias("_shuffle_row"))
    salted = cold.unionByName(counted.withColumn("_shuffle_row", F.explode(F.sequence(F.lit(1), "_shuffle_row"))))
    placed = salted.withColumn("_shuffle_bucket", F.pmod(F.xxhash64(F.lit(seed), "_shuffle_key", "_shuffle_row"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("_shuffle_bucket").count()
    before = Window.orderBy("_shuffle_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket of many MB
    firsts = counts.select("_shuffle_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shuffle_first"))
    inner = ["_shuffle_bucket", "_shuffle_first", "_shuffle_key", "_shuffle_row"]
    both = placed.select(*named, "_shuffle_bucket", F.lit(None).cast("long").alias("_shuffle_first"), "_shuffle_key", "_shuffle_row").unionByName(
        firsts, allowMissingColumns=True)
    dealt = both.repartition(buckets, "_shuffle_bucket").sortWithinPartitions(
        "_shuffle_bucket", F.col("_shuffle_first").desc_nulls_last(), "_shuffle_key", "_shuffle_row")
    kept = T.StructType([docs.schema[c] for c in columns])
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(batches):
        held: list[pa.RecordBatch] = []
        current = first = None

        def bucket():
            rows = permuted(pa.Table.from_batches(held), seed, current)
            place = first + np.arange(rows.num_rows, dtype=np.int64)
            rows = rows.drop_columns(inner).append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))
            yield from rows.to_batches(max_chunksize=2048)

        for batch in batches:
            numbers = batch["_shuffle_bucket"].to_numpy()
            marks = batch["_shuffle_first"].to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != current:
                    if held:
                        yield from bucket()
                    held, current = [], int(numbers[a])
                if marks[a] is not None:
                    first, a = marks[a], a + 1
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from bucket()

    return dealt.mapInArrow(deal, out)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes one folder per shard and returns the shards as read back."""
    dealt = shuffle_into_shards(docs, shards, seed, bucket_bytes)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)
