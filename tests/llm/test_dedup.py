"""Near-duplicates and repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import empty, frame, prose, rows
from pyspark.sql import functions as F

from stratafold.llm import near, suffix
from stratafold.llm.run_index import RunIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def components(texts, n, percent):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def chains(seed):
    """Texts that drift: neighbours are alike, ends of the chain are not."""
    rng = random.Random(seed)
    words = prose(rng, 120).split(" ")
    out = []
    for i in range(14):
        words = list(words)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{i}{rng.random()}"
        out.append(" ".join(words))
    return out


def test_components_match_brute_force(spark):
    some = rows(6, 60) + [(1000 + i, t, *[None] * 6) for i, t in enumerate(chains(1))] + [(None, "null id", *[None] * 6)]
    got = near.near_duplicates(frame(spark, some), n=4, percent=80).collect()
    want = components({r[0]: r[1] for r in some if r[0] is not None}, 4, 80)
    assert len(got) == len(some)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_no_rows_and_no_links(spark):
    assert near.near_duplicates(empty(spark)).count() == 0
    some = [(1, "a b c d e f", *[None] * 6), (2, "g h i j k l", *[None] * 6)]
    assert [r["kept"] for r in near.near_duplicates(frame(spark, some)).collect()] == [True, True]


def test_sketches_tell_how_many_samples_differ():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for share, alike in ((0.05, True), (0.3, False), (1.0, False)):
        other = base.copy()
        other[: int(share * 1000)] = rng.integers(0, 1 << 63, int(share * 1000)).astype(np.uint64)
        samples = near.samples_of(np.repeat([0, 1], 1000), np.concatenate([np.sort(base), np.sort(other)]))
        a, b = near.odd_sketches(samples)
        differ = int((samples[:, 0] != samples[:, 1]).sum())
        z = int(np.bitwise_count(a ^ b).sum())
        estimate = -near.WORDS * 32 * np.log(max(1e-9, 1 - 2 * z / (near.WORDS * 64)))
        assert abs(estimate - 2 * differ) < 40 or differ > 120
        assert (z <= near.most_different(80)) == alike or 0.2 < share < 0.5


def removed(texts, span):
    seen, out = {}, {}
    for k in sorted(texts):
        data = (texts[k] or "").encode()
        mark = bytearray(len(data))
        strings = [data[i:i + span] for i in range(len(data) - span + 1)]
        for i, s in enumerate(strings):
            if s in seen:
                mark[i:i + span] = b"\1" * span
        for s in strings:
            seen.setdefault(s, k)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[k] = (len(data), sum(mark), spans, bytes(x for x, m in zip(data, mark) if not m))
    return out


@pytest.mark.parametrize("chunk", [1 << 23, 3000])
def test_passages_match_brute_force(spark, chunk):
    some = rows(8, 60)
    want = removed({r[0]: r[1] for r in some}, 50)
    got = suffix.without_earlier(frame(spark, some), span=50, chunk_bytes=chunk).collect()
    assert len(got) == len(some) and any(w[1] for w in want.values())
    for r in got:
        assert (r["_dedup_bytes"], r["_dedup_removed"], r["_dedup_spans"], bytes(r["_dedup_kept"])) == want[r["doc_id"]]
        assert r["key"] == "k"


def test_passages_of_null_and_repeated_ids_and_no_rows(spark):
    text = "abcdefghij" * 8
    some = [(None, text, *[None] * 6), (5, text, *[None] * 6), (5, text, *[None] * 6), (9, "xx" + text[:60], *[None] * 6)]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["_dedup_removed"]) for r in suffix.without_earlier(frame(spark, some)).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 9, 60), (True, None, 80)]
    assert suffix.without_earlier(empty(spark)).count() == 0


def test_whole_characters_stay_text(spark):
    text = "é" * 40
    some = [(1, "x" + text, *[None] * 6), (2, "ü" + text[:30] + "日本", *[None] * 6), (3, text, *[None] * 6)]
    found = suffix.without_earlier(frame(spark, some), whole_characters=True).withColumn("kept", F.col("_dedup_kept").cast("string"))
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == {1: "x" + text, 2: "ü日本", 3: ""}


def test_matching_statistics_match_brute_force():
    rng = random.Random(1)
    for _ in range(15):
        base = bytes(rng.choice(b"ab\0c") for _ in range(300))
        strings = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 200)
            s = bytearray(base[a:a + rng.randint(0, 140)])
            if s and rng.random() < 0.6:
                s[rng.randrange(len(s))] = rng.choice(b"abcx")
            strings.append(bytes(s))
        index = RunIndex(strings)
        patterns = strings[:3] + [bytes(rng.choice(b"abcz") for _ in range(80)), base[20:200]]
        starts, lengths, rows_ = index.statistics(patterns, 50)
        for p, s in zip(patterns, starts):
            for i in range(len(p)):
                m = 0
                while m < 50 and i + m < len(p) and any(p[i:i + m + 1] in t for t in strings):
                    m += 1
                at = index.order[rows_[s + i]]
                assert lengths[s + i] == m and bytes((index.text[at:at + m] - 1).astype(np.uint8)) == p[i:i + m]


def test_links_between_components_are_found_in_tiles(spark, monkeypatch):
    """The second step alone, from no links at all, in tiles of a few classes: it must join what brute force joins."""
    monkeypatch.setattr(near, "TILE", 3)
    texts = dict(enumerate(chains(1) + chains(2) + [chains(1)[3], ""]))
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    signed = near.signatures(docs, 4).filter("n_shingles > 0")
    classes = signed.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).cache()
    members = classes.select("rep", F.explode("bands").alias("key"))
    members = members.join(members.groupBy("key").count().filter("count > 1").select("key"), "key").cache()
    sets = near._sets(docs, members.select(F.col("rep").alias("id")).distinct(), 4)
    none = spark.createDataFrame([], "id long, root long")
    links = [(r["a"], r["b"]) for r in near._across(members, none, classes, sets, 80).collect()]
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {k: r for k, (_, r) in components(texts, 4, 80).items()}
    reps = {r["rep"] for r in classes.collect()}
    assert {k: find(k) for k in reps} == {k: want[k] for k in reps}
    assert len(links) < 200


def test_common_counts_of_rows():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 100)) for _ in range(20)]
    x, y = np.triu_indices(20, 1)
    got = near._common(np.repeat(np.arange(20), [len(s) for s in sets]), np.concatenate(sets), 20, x, y)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]


@pytest.mark.parametrize("size", [1, 3, 5, 6, 7, 20, 47, 48, 50, 96, 97, 130])
def test_ranges_of_rows_agree_with_slices_at_any_size(size):
    random = np.random.default_rng(5)
    whole = bytes(random.integers(97, 99, 200).astype(np.uint8))
    varied = [whole[:k] + b"z" + whole[k + 1:] for k in (10, 30, 47, 60, 100, 120, 150)]
    strings = [whole, whole[40:], *varied]
    index = RunIndex(strings)
    first, full = index.intervals(size)
    joined = b"".join(s + b"\0" for s in strings)
    heads = [joined[i:min(i + size, index.end[i])] for i in index.order]
    limits = [*first.tolist(), len(heads)]
    ranges = [heads[a:b] for a, b in zip(limits, limits[1:])]
    whole_ranges = [r for r, ok in zip(ranges, full) if ok]
    assert all(len(set(r)) == 1 and len(r[0]) == size for r in whole_ranges)
    assert len({r[0] for r in whole_ranges}) == len(whole_ranges) == len({h for h in heads if len(h) == size})


@pytest.mark.parametrize("span", [20, 21, 22, 25, 50, 96])
def test_every_string_holds_a_stretch_around_its_anchor(span):
    need = span - suffix.ANCHOR
    for left in range(need + 1):
        assert any(left >= a and need - left >= b for a, b in suffix._stretches(span))


def test_texts_are_asked_only_of_pieces_that_another_document_continues():
    """Four different pieces with one anchor: two share a stretch, of two documents; the others share none, or are of one document."""
    pieces = np.array([11, 12, 13, 14, 15], np.uint64)
    owners = np.array([5, 3, 2, 7, 7], np.int64)
    around = np.array([[8, 0, 9], [8, 1, 0], [0, 2, 4], [0, 3, 5], [0, 3, 6]], np.uint32)
    rows = pa.table({"bucket": [0], "_dedup_chunk": [6], "piece": [pieces.tobytes()], "anchor": [np.full(5, 77, np.uint32).tobytes()],
                     "owner": [owners.tobytes()], "around": [around.tobytes()]})
    got = {r["kind"]: np.frombuffer(r["piece"], np.uint64).tolist() for r in suffix._smallest_owners(rows).to_pylist()}
    assert got == {1: [11], 3: [12]}  # 11 is searched in the index, 12 only lies in it
