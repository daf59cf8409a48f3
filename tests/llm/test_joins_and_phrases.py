"""The n-gram join, phrase mining and the repair of conversations against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_corpus import empty, frame, rows
from pyspark.sql import functions as F

from stratafold.llm import collocations, jaccard_join, repair

LOWER = {c: c + 32 for c in range(65, 91)}


def joined(some, n, percent):
    """Set size and smallest id reachable of each row, by comparing all pairs."""
    sets = []
    for _, text in some:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    up = list(range(len(some)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            common = len(a & sets[y])
            if common and 100 * common >= percent * (len(a) + len(sets[y]) - common):
                up[top(x)] = top(y)
    names = {}
    for x, (doc_id, _) in enumerate(some):
        names[top(x)] = min(names.get(top(x), doc_id), doc_id)
    return sorted((some[x][0], len(sets[x]), names[top(x)]) for x in range(len(some)))


def edited_groups(seed):
    rng = random.Random(seed)
    found = []
    for _ in range(30):
        base = [str(rng.randrange(10**6)) for _ in range(rng.choice([2, 5, 11, 12, 14, 20, 22, 25, 31, 40, 60, 150]))]
        for _ in range(rng.randrange(1, 10)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.choice([0, len(words) - 1, rng.randrange(len(words))])
                words[at:at + rng.randrange(2)] = ["x%d" % rng.randrange(9)] * rng.randrange(2)
                if not words:
                    words = ["one"]
            found.append((3 * len(found) + 1, " ".join(words)))
    return found


@pytest.mark.parametrize("limit,tile,short", [(None, 2048, 256), (0, 4, 0), (20, 4, 4), (32, 2, 1000)])
def test_join_loses_no_link(spark, monkeypatch, limit, tile, short):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    some = edited_groups(seed=(limit or 0) + tile) + [(r[0] + 10**6, r[1]) for r in rows()] + [(9, None), (8, "A b C"), (7, "a B c")]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(4).withColumn("gram", F.lit(1)).withColumn("Size", F.lit("x"))
    got = sorted(tuple(r) for r in jaccard_join.similar_documents(docs, 3, 90, limit).collect())
    assert got == joined(some, 3, 90)


def test_join_of_other_similarities(spark):
    some = edited_groups(seed=77)
    got = sorted(tuple(r) for r in jaccard_join.similar_documents(spark.createDataFrame(some, "doc_id long, text string"), 2, 70).collect())
    assert got == joined(some, 2, 70)


def test_join_of_rows_without_id_and_no_rows(spark):
    assert jaccard_join.similar_documents(empty(spark)).count() == 0
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(None, text), (None, text), (5, text + " x"), (6, None), (7, ""), (7, text)], "doc_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_join.similar_documents(docs, 3, 90).collect()), key=str)
    assert got == sorted([(None, 38, 5), (None, 38, 5), (5, 39, 5), (6, 0, 6), (7, 0, 7), (7, 38, 5)], key=str)


def test_sizes_of_subsets_cover_every_pair():
    for percent in (70, 80, 90):
        for a in range(1, 40):
            for b in range(a, 40):
                if 100 * a >= percent * b:
                    k = jaccard_join.needed(a, b, percent)
                    if a != b or k < a:
                        assert k in jaccard_join.subset_sizes(a, percent) and k in jaccard_join.subset_sizes(b, percent)


def test_a_giant_component_is_not_compared_with_itself(spark):
    some = [(gram, 200, rep, 1 if rep < 190 else rep) for gram in (5,) for rep in range(200)]
    jaccard_join.TILE, before = 16, jaccard_join.TILE
    try:
        tiles = jaccard_join._tiles(spark.createDataFrame(some, "gram long, m long, rep long, root long")).collect()
    finally:
        jaccard_join.TILE = before
    sides = {(r["low"], r["high"]): set() for r in tiles}
    for r in tiles:
        sides[r["low"], r["high"]].add(r["side"])
    assert not any(low < 0 and high < 0 for low, high in sides)
    met = Counter()
    for r in tiles:
        met[r["rep"]] += 1
    assert met[199] == 1 + 12 and met[0] == 1  # the ten others meet 12 tiles of the giant and their own


def mined(some, least, most):
    total, f = Counter(), Counter()
    for lang, text in some:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            found[lang, w] = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
    out = []
    for lang in total:
        best = []
        for (own, w), (score, k) in found.items():
            around = [f[o, x] for o, x in found if o == own and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x)))]
            if own == lang and not any(100 * n >= 80 * f[own, w] for n in around):
                best.append((-score, -f[own, w], " ".join(w).encode(), f[own, w[:k]], f[own, w[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("heads,held,dense", [(1 << 19, 1 << 21, 1 << 17), (0, 50, 1), (7, 300, 2)])
def test_phrases_match_plain_counts(spark, monkeypatch, heads, held, dense):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "SLICE", 200)
    rng = random.Random(heads)
    vocabulary = ["the", "Of", "é", "new", "york", "city", "x\x1cy", "longer" * 40, "a", "b"]
    some = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    some += [("en", None), (None, ""), ("en", " ., "), ("en", "New york city " * 30), ("en", "New york city " * 30)]
    docs = spark.createDataFrame(some, "lang string, text string").repartition(3).withColumn("KEY", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, most=25, heads=heads).collect())
    assert got == mined(some, 5, 25)


def test_phrases_of_no_rows(spark):
    assert collocations.collocations(empty(spark)).count() == 0


def test_pairs_are_counted_in_tiles_and_lists():
    rng = np.random.default_rng(4)
    left, right = rng.integers(-3, 3000, 400_000), rng.integers(-3, 1500, 400_000)
    want = Counter(zip(left.tolist(), right.tolist()))
    a, b, n = collocations.counted(left, right)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want


def cheapest(kinds):
    """The least cost and its least letters, by trying every edit."""
    ends = {repair.NOTHING: (0, ""), repair.SYSTEM: (10, "II"), repair.USER: (5, "I"), repair.ASSISTANT: (0, "")}
    best = ends
    for kind in reversed(kinds):
        plain = {}
        for state in range(4):
            options = [(2 + best[state][0], "D" + best[state][1])]
            for initial in {0: "su", 1: "u", 2: "a", 3: "u"}[state]:
                if kind != "x":
                    own, broken, after = kind.lower(), 5 * kind.isupper(), {"s": 1, "u": 2, "a": 3}[initial]
                    if initial == own:
                        options.append((broken + best[after][0], "K" + best[after][1]))
                    elif initial != "s":
                        options.append((1 + broken + best[after][0], "R" + best[after][1]))
            plain[state] = min(options)
        put = lambda k, s: (5 * k + plain[s][0], "I" * k + plain[s][1])  # noqa: B023, E731
        best = {0: min(plain[0], put(1, 2), put(2, 3)), 1: min(plain[1], put(1, 2), put(2, 3)), 2: min(plain[2], put(1, 3)), 3: min(plain[3], put(1, 2))}
    return best[0]


def test_block_tables_give_the_cheapest_edits():
    rng = random.Random(8)
    for _ in range(3000):
        kinds = "".join(rng.choices(repair.KINDS, k=rng.randrange(14)))
        form, cost, _ = repair.cost_before(kinds)
        letters = "".join(re.sub("[ua]", "I", re.sub("([DKR]).$", r"\1", s)) for s in repair.trace(kinds)[0])
        assert (cost + repair.tables()[0][form][repair.NOTHING], letters) == cheapest(kinds)


def by_hand(conversation):
    """What is wrong and the repaired lines of one conversation's ordered rows (turn, role, text)."""
    kinds, counts, seen = [], Counter(), set()
    for _, role, text in conversation:
        last = (text.rstrip(" \t\n\x0b\x0c\r") or " ")[-1]
        fault = "blank" if last == " " else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        own = role[:1] if role[:1] in "uas" and role else "o"
        kinds.append("x" if fault in ("blank", "duplicate") else own.upper() if fault else own)
    cost, letters = cheapest("".join(kinds))
    lines, i = [], 0
    for letter in letters:
        put = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        if letter == "I":
            lines.append((put, ""))
            continue
        if letter != "D":
            lines.append((conversation[i][1] if letter == "K" else put, conversation[i][2]))
        i += 1
    initials = [r[1][:1] for r in conversation]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in conversation if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest


@pytest.mark.parametrize("size", [1 << 16, 3])
def test_repair_matches_trying_every_edit(spark, size):
    rng = random.Random(size)
    texts = ["Yes.", "no", " ", "", "What?\n", "é!", "same.", "same.", "x" * 3000 + "."]
    some = []
    for conv in [None, *range(40)]:
        for _ in range(rng.choice([0, 1, 2, 5, 9, 40])):
            some.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "assistant", "system", "tool", " ", ""]), rng.choice(texts), 0))
    listed = spark.createDataFrame([(c,) for c in [None, *range(40)]], "conv_id long")
    rows_ = spark.createDataFrame(some, "conv_id long, turn long, role string, text string, copy int").repartition(3).withColumn("place", F.lit("x")).withColumn("Kind", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(listed, rows_, size).collect()}
    for conv in [None, *range(40)]:
        own = sorted((r[1:4] for r in some if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert got.pop(conv) == by_hand(own)
    assert not got


def test_damage_and_no_rows(spark):
    some = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(3)] + [(None, None, None, None), (5, None, "user", None)]
    out = repair.damaged(spark.createDataFrame(some, "conv_id long, turn long, role string, text string")).collect()
    kinds = Counter((r["role"], r["text"], r["copy"]) for r in out)
    assert kinds["assistant", "", 0] and kinds["assistant", "One Two Three", 0] and kinds["assistant", "One. Two! Three?", 1] and kinds["user", "One. Two! Three?", 0]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none, repair.damaged(none)).count() == 0


def test_only_candidates_for_the_first_places_are_spelled(spark, monkeypatch):
    asked, plain = [], collocations.spellings
    monkeypatch.setattr(collocations, "spellings", lambda docs, wanted: asked.append(len(wanted.keys)) or plain(docs, wanted))
    some = [("en", " . ".join(" ".join([f"a{i} b{i}"] * 1 + ["x"] * (i % 3)) for i in range(40)))] * 6 + [("en", "first second")] * 9
    docs = spark.createDataFrame(some, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, most=1).collect())
    assert got == mined(some, 5, 1) and asked == [2]


def test_entries_without_a_partner_by_size_leave_their_list(spark):
    some = [(1, 100, 0, [7]), (2, 95, 0, [7]), (3, 300, 0, [7]), (4, 80, 0, [7]), (5, 40, 0, [8]), (6, 50, 0, [8]), (7, 100, 1, [9]), (8, 300, 1, [9])]
    classes = spark.createDataFrame(some, "rep long, size long, hot int, prefix array<long>")
    got = sorted((r["gram"], r["rep"]) for r in jaccard_join._met(classes, 0, 90).collect())
    assert got == [(7, 1), (7, 2), (9, 7), (9, 8)]  # the list of 9 is hot, and goes by parts


def test_full_sets_are_compared_from_texts_that_come_twice(spark):
    words = [str(i) for i in range(60)]
    some = [(i, " ".join(words[:30 + i] + ["x%d" % i] + words[30 + i:])) for i in range(9)]
    docs = spark.createDataFrame(some + some, "doc_id long, text string").repartition(5)
    classes = jaccard_join.signatures(docs, 3, 80).groupBy(F.col("d1").alias("rep")).agg(
        F.first("key").alias("key"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"))
    reps = classes.select(F.lit(1).cast("long").alias("gram"), "rep")
    none = spark.createDataFrame([], "rep long, root long")
    links = [(r["a"], r["b"]) for r in jaccard_join._across(reps, none, classes, docs, 3, 80).collect()]
    assert len(links) == 8 and len({x for pair in links for x in pair}) == 9  # as few as join all
