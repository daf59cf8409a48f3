"""Exact top-k against a full sort, on odd vectors and on ties."""

import numpy as np
from pyspark.sql import functions as F

from stratafold.llm import topk


def brute(vectors, is_query, k):
    out = []
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None for x in v)]
    for q, v in good:
        if is_query(q):
            found = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def ask(spark, vectors, k):
    df = spark.createDataFrame(vectors, "vec_id long, v array<bigint>").withColumn("rank", F.lit("clash")).repartition(3)
    got = topk.top_k(df, "vec_id", F.col("v"), F.col("vec_id") % 5 == 0, k)
    return sorted(tuple(r) for r in got.collect())


def test_matches_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-9, 9, 8).tolist()) for i in range(300)]
    assert ask(spark, vectors, 5) == brute(vectors, lambda q: q % 5 == 0, 5)


def test_ties_repeats_nulls_lengths_and_large_numbers(spark):
    vectors = [(i, [1, 2]) for i in range(12)] + [(3, [1, 2]), (None, [1, 2]), (20, None), (25, []), (30, [1, None]), (35, [4]), (40, [7]), (45, [1 << 29, -(1 << 28)]), (46, [1 << 29, 5])]
    assert ask(spark, vectors, 4) == brute(vectors, lambda q: q % 5 == 0, 4)


def test_few_or_no_rows(spark):
    assert ask(spark, [(5, [1, 1]), (6, [2, 2])], 5) == [(5, 1, 6, 4)]
    assert ask(spark, [], 5) == []


def test_bounds_stop_early():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (2000, 8))
    vectors[:6] *= 100
    queries = vectors[:3]
    q, v, s = topk.best_of_block(np.arange(2000), vectors, np.arange(3), queries, 3)
    assert len(q) < 3 * 2000
    for i in range(3):
        want = sorted(((-int(vectors[j] @ queries[i]), j) for j in range(2000) if j != i))[:3]
        have = sorted((-int(x), int(j)) for a, j, x in zip(q, v, s) if a == i)[:3]
        assert have == want


def test_cells_of_many_lanes_and_groups_match_a_full_sort(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 4), ("LANE", 256), ("LEAST_LANE", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    vectors = [(i % 190, rng.integers(-5, 6, 8).tolist()) for i in range(200)] + [(i, rng.integers(-1 << 20, 1 << 20, 3).tolist()) for i in range(200, 240)]
    assert ask(spark, vectors, 5) == full_sort(vectors, lambda q: q % 5 == 0, 5)


def full_sort(vectors, is_query, k):
    """As ``brute``, with rows that share an id ranked together."""
    found: dict = {}
    for q, v in vectors:
        if is_query(q):
            found.setdefault(q, []).extend((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
    return sorted((q, r + 1, i, -s) for q, some in found.items() for r, (s, i) in enumerate(sorted(some)[:k]))


def test_queries_are_never_broadcast(spark):
    # copied once per lane they are many times what Spark takes them for, and a broadcast goes through the driver
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: (F.col("id") * 31 + j * 17) % 23 - 11).alias("v"))
    found = topk.top_k(df, "id", F.col("v"), F.col("id") % 50 == 0, 3)
    assert len(found.collect()) == 24
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_bar_from_earlier_blocks_leaves_less_and_nothing_that_counts():
    rng = np.random.default_rng(1)
    vectors, queries = rng.integers(-9, 10, (500, 16)), rng.integers(-9, 10, (4, 16))
    scores = queries @ vectors.T
    bars = np.sort(scores, axis=1)[:, -3]
    q, v, s = topk.best_of_block(np.arange(500), vectors, np.arange(900, 904), queries, 3, bars, 1)
    assert len(q) <= topk.RESOLVE * 3 * 4
    assert set(zip(*np.nonzero(scores >= bars[:, None]))) <= set(zip(q, v))
    assert (s == scores[q, v]).all()
