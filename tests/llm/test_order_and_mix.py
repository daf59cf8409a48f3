"""Sharding and mixing: laws, seeds and brute-force selections."""

import hashlib
import random

import pytest
from llm_corpus import empty, frame, rows
from pyspark.sql import functions as F

from stratafold.llm import mixing, sharding
from stratafold.session import shared_path


def dealt(spark, some, **kinds):
    got = sharding.write_shards(frame(spark, some), shared_path(spark, "s"), **kinds)
    return got.select("doc_id", "text", "source", "shard", "slot").collect()


def test_counts_are_at_most_one_apart_and_slots_gapless(spark):
    some = rows() + [rows()[0]] * 30
    got = dealt(spark, some, shards=8, seed=1, bucket_bytes=4096)
    by = {}
    for r in got:
        by.setdefault(int(r["shard"]), []).append(r["slot"])
    sizes = [len(x) for x in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    key = lambda r: (r[0], r[1] or "", r[1] is None)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(((r[0], r[1]) for r in some), key=key)


def test_seed_decides_the_order(spark):
    some = rows()
    place = lambda got: {r["doc_id"]: (int(r["shard"]), r["slot"]) for r in got}
    a = place(dealt(spark, some, shards=3, seed=1))
    assert a == place(dealt(spark, some[::-1], shards=3, seed=1)) != place(dealt(spark, some, shards=3, seed=2))


def test_every_record_is_as_likely_in_every_slot():
    import pyarrow as pa

    rows_ = pa.table({"x": list(range(4))})
    seen = {tuple(sharding.permuted(rows_, s, 0)["x"].to_pylist()) for s in range(400)}
    assert len(seen) == 24


def test_no_rows(spark):
    assert sharding.write_shards(empty(spark), shared_path(spark, "s"), shards=4).count() == 0
    assert mixing.mixed(empty(spark), F.array("source"), mixing.word_count(F.col("text")), [1], 1.5, 2).count() == 0


def test_flow_fills_quotas_with_least_repetition():
    # one pattern in both sources, one in the second only
    sent = mixing.flow([10, 10], [[0, 1], [1]], [8, 14], 2)
    assert sent[0][0] == 8 and sent[0].get(1, 0) + sent[1][1] == 14
    assert sum(max(0, sum(f.values()) - 10) for f in sent) == 2  # words are repeated only where nothing fresh is left
    rng = random.Random(2)
    for _ in range(40):
        n, s = rng.randint(1, 5), rng.randint(1, 4)
        cap = [rng.randint(0, 9) for _ in range(n)]
        members = [rng.sample(range(s), rng.randint(1, s)) for _ in range(n)]
        quota = [rng.randint(0, 14) for _ in range(s)]
        sent = mixing.flow(cap, members, quota, 2)
        # largest flow by checking every cut of the sources
        most = min(sum(q for j, q in enumerate(quota) if not c >> j & 1) + sum(2 * cap[p] for p in range(n) if any(c >> j & 1 for j in members[p])) for c in range(1 << s))
        assert sum(sum(f.values()) for f in sent) == most
        assert all(sum(f.values()) <= 2 * c for f, c in zip(sent, cap))
        assert all(sum(f.get(j, 0) for f in sent) <= quota[j] for j in range(s))
        fresh = min(sum(q for j, q in enumerate(quota) if not c >> j & 1) + sum(cap[p] for p in range(n) if any(c >> j & 1 for j in members[p])) for c in range(1 << s))
        assert sum(min(c, sum(f.values())) for f, c in zip(sent, cap)) == fresh


def test_shares_stop_at_the_cap_and_reshare():
    sizes = {"a": 10, "b": 100, None: 90}
    got = mixing.shares(sizes, [3, 1, 2], 1.5, 2)
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(300)
    assert got[None] == 180 and got["b"] == pytest.approx(100)
    assert mixing.shares({"a": 0}, [1], 1.5, 2) == {"a": 0}


def test_selection_matches_a_plain_walk(spark):
    some = rows() + [rows()[3]] * 2
    docs = frame(spark, some)
    got = mixing.mixed(docs, F.array("source"), mixing.word_count(F.col("text")), [3, 1, 2], 1.5, 2, seed=4)
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    sizes = {}
    for r in some:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = mixing.shares(sizes, [3, 1, 2], 1.5, 2)
    want = []
    for s in sizes:
        own = sorted((hashlib.md5(f"4:{r[0]}".encode()).hexdigest(), r[0], size(r[1])) for r in some if r[3] == s)
        passes, left = divmod(int(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, doc_id, n in own:
            more = max(0, min(n, left))
            left -= more
            want.append((doc_id, n, passes * n + more))
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got.collect()) == sorted(want)
    again = mixing.repeated(got, ["doc_id", "text", "n_chars"]).withColumn("w", mixing.word_count(F.col("text")))
    # whole documents only: the one that the quota cuts goes in or not, whichever is nearer
    times = {}
    for doc_id, n, taken in want:
        times[doc_id] = times.get(doc_id, 0) + (n and (2 * taken + n) // (2 * n))
    counts = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {k: t for k, t in times.items() if t}
    assert {(r["doc_id"], r["text"]) for r in again.collect()} <= {(r[0], r[1]) for r in some}


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 else ["b"]) for i in range(60)], "doc_id long, text string, m array<string>")
    got = mixing.mixed(docs, F.col("m"), mixing.word_count(F.col("text")), [1, 2], 1.2, 2)
    r = got.agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("m")).first()
    assert r["m"] <= 2 and r["t"] > 0


def test_targets_in_spark_are_those_of_the_plain_rule(spark):
    rng = random.Random(5)
    for weights, share in (([3, 1, 2], 1.5), ([1], 3.0), ([0.5, 4], 0.4)):
        sizes = {f"s{i}": rng.choice([0, 1, 7, 50, 900]) for i in range(12)} | {None: 30}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, words long"), weights, share, 2).collect()
        want = mixing.shares(sizes, weights, share, 2)
        assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_names_that_clash_stay_or_give_way(spark):
    names = ["_rest", "_order", "_bin", "mix", "row", "order", "_m", "end", "before", "passes", "SIZE", "_copy", "x`y"]
    docs = frame(spark, rows())
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    kinds = dict(weights=[3, 1, 2], share=1.5, most=2, seed=4)
    plain = mixing.mixed(frame(spark, rows()), F.array("source"), mixing.word_count(F.col("text")), **kinds)
    got = mixing.mixed(docs, F.array("source"), mixing.word_count(F.col("text")), **kinds)
    assert sorted(got.select("doc_id", "size", "taken").collect()) == sorted(plain.select("doc_id", "size", "taken").collect())
    assert "SIZE" not in got.columns and {r["_rest"] for r in got.collect()} == {"_rest"}
    whole = mixing.mixed_documents(docs, F.array("source"), mixing.word_count(F.col("text")), **kinds)
    assert whole.columns == docs.columns and {(r["SIZE"], r["x`y"], r["_copy"]) for r in whole.collect()} == {("SIZE", "x`y", "_copy")}
    count = lambda df: sorted((r["doc_id"], r["count"]) for r in df.groupBy("doc_id").count().collect())
    assert count(whole) == count(mixing.repeated(plain, ["doc_id", "text"]))


def test_deep_bins_select_the_same(spark):
    some = rows() + [(None, f"null id {i}", "en", "s") + tuple(rows()[0][4:]) for i in range(40)]
    docs = frame(spark, some)
    found = [sorted(map(str, mixing.mixed(docs, F.array("source"), mixing.word_count(F.col("text")), [3, 1, 2], 1.5, 2, seed=4, last_bin=b).select("doc_id", "text", "taken").collect()))
             for b in (1, 100_000)]
    assert found[0] == found[1]


def test_documents_of_no_source_are_not_taken(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "a b c", []), (3, "d", [None]), (4, "e f", ["x"]), (5, None, ["x"])], "doc_id long, text string, m array<string>")
    got = {r["doc_id"]: r for r in mixing.mixed(docs, F.col("m"), mixing.word_count(F.col("text")), [1], 1.0, 2).collect()}
    assert (got[1]["taken"], got[2]["taken"], got[1]["targets"], got[5]["taken"]) == (0, 0, [], 0)
    assert got[3]["source_sizes"] == [1] and got[3]["taken"] + got[4]["taken"] == 2 and len(got) == 5


def test_overlap_takes_as_much_as_any_flow_could(spark):
    rng = random.Random(8)
    sets = [["a"], ["a", "b"], ["b", "c"], ["c"], ["d"]]
    some = [(i, "w " * rng.randint(1, 9), rng.choice(sets)) for i in range(80)]
    docs = spark.createDataFrame(some, "doc_id long, text string, m array<string>")
    got = mixing.mixed(docs, F.col("m"), mixing.word_count(F.col("text")), [1, 3, 2], 1.4, 2, seed=1).collect()
    sizes, words = {}, {}
    for _, text, m in some:
        words[tuple(m)] = words.get(tuple(m), 0) + len(text.split())
        for s in m:
            sizes[s] = sizes.get(s, 0) + len(text.split())
    quota = {s: int(t) for s, t in mixing.shares(sizes, [1, 3, 2], 1.4, 2).items()}
    names = sorted(quota)
    cuts = [set(n for i, n in enumerate(names) if c >> i & 1) for c in range(1 << len(names))]
    bound = lambda times: min(sum(q for s, q in quota.items() if s not in c) + sum(times * w for m, w in words.items() if c & set(m)) for c in cuts)
    assert sum(r["taken"] for r in got) == bound(2)
    taken = {}
    for r in got:
        taken[tuple(r["m"])] = taken.get(tuple(r["m"]), 0) + r["taken"]
    assert sum(min(w, taken[m]) for m, w in words.items()) == bound(1)  # nothing is repeated while fresh words are left
