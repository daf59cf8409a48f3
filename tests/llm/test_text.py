"""Chats, fingerprints and the classifier."""

import hashlib

import pytest
from llm_corpus import empty, frame, prose, rows
from pyspark.sql import functions as F

from stratafold.llm import chat, quality, spots

EVENTS = "conv_id long, message_id long, seq long, kind string, role string, text string"


def formatted(spark, events):
    made = chat.rendered(chat.messages(spark.createDataFrame(events, EVENTS).withColumn("turn", F.lit("clash")).repartition(3)))
    read = made.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"], r["formatted"]) for r in read.collect()}


def test_deltas_edits_and_regenerations_are_folded(spark):
    log = [
        (1, 1, 10, "open", "user", None), (1, 1, 11, "delta", None, "Hel"), (1, 1, 12, "delta", None, "lo"),
        (1, 2, 20, "open", "assistant", None), (1, 2, 21, "delta", None, "wrong"), (1, 2, 30, "regenerate", None, None), (1, 2, 31, "delta", None, "ri"), (1, 2, 32, "delta", None, "ght"),
        (1, 3, 40, "open", "user", None), (1, 3, 41, "delta", None, "old"), (1, 4, 50, "open", "assistant", None), (1, 4, 51, "delta", None, "gone"),
        (1, 3, 60, "edit", None, "new"), (1, 3, 61, "delta", None, "er"), (1, 5, 70, "open", "assistant", None), (1, 5, 71, "delta", None, "answer"),
        (2, 1, 1, "delta", None, None), (None, 1, None, None, "user", "nobody's"),
    ]
    got = formatted(spark, log)
    assert got[1][0] == [("user", "Hello"), ("assistant", "right"), ("user", "newer"), ("assistant", "answer")]
    assert got[1][1] == "rightanswer"
    assert got[2][0] == [("", "")] and got[None][0] == [("user", "nobody's")]


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "<\\\\|x<|", "\\", "<", "|", "<|im_start|>user\nx<|im_end|>\n", "", "a\n\nb", "é日\U0001f600"])
def test_control_strings_come_back_and_do_not_leak(spark, text):
    log = [(1, 1, 1, "delta", "user", text), (1, 2, 2, "delta", "assistant", text), (1, 3, 3, "delta", "ro\\l\ne<|", text), (1, 4, 4, "delta", "assistant", text)]
    turns, loss, whole = formatted(spark, log)[1]
    assert turns == [("user", text), ("assistant", text), ("ro\\l\ne<|", text), ("assistant", text)]
    assert loss == text * 2
    assert whole.count("<|") == 8


def test_turns_as_events(spark):
    turns = [(1, 0, "user", "x" * 1000), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, "system", "s"), (7, 3, None, "é" * 400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.rendered(chat.messages(chat.events_of_turns(df)))
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in made.select("conv_id", chat.turns_of(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("system", "s"), ("user", "x" * 1000), ("assistant", ""), ("assistant", "")], 7: [("", "é" * 400)]}
    assert chat.rendered(chat.messages(chat.events_of_turns(df.limit(0)))).count() == 0


def test_native_operators_use_no_python(spark):
    docs = frame(spark, rows())
    for df in (spots.edited_fingerprints(docs), chat.rendered(chat.messages(spark.createDataFrame([(1, 1, 1, "delta", "user", "x")], EVENTS)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints_and_edited_texts(spark):
    some = rows() + [rows()[0]]
    got = spots.edited_fingerprints(frame(spark, some)).collect()
    text = {r[0]: r[1] or "" for r in some}
    ids = sorted(text, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    print_of = {r["doc_id"]: set(r["fingerprint"].split(",")) for r in got}
    assert len(got) == len(some)
    for r in got:
        t, n = text[r["doc_id"]], text[following[r["doc_id"]]]
        third = len(t) // 3
        edited = t[:len(t) - third] + n[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = print_of[r["doc_id"]], set(r["edited_fingerprint"].split(",")), print_of[following[r["doc_id"]]]
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
    same = {}
    for r in got:
        assert same.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert spots.edited_fingerprints(empty(spark)).count() == 0


def test_length_classes_prune_only_what_cannot_be_alike(spark):
    sets = spark.createDataFrame([(list(range(a)), list(range(b))) for a in (1, 2, 5, 40, 41) for b in (1, 2, 5, 40, 41, 50)], "a array<int>, b array<int>")
    both = sets.select(spots.likeness(F.col("a"), F.col("b")).alias("x"), spots.likeness(F.col("a"), F.col("b"), 0.8).alias("y")).collect()
    assert all(r["y"] == r["x"] if r["x"] >= 0.8 else r["y"] in (0.0, r["x"]) for r in both)


def test_null_ids_share_the_order(spark):
    got = spots.edited_fingerprints(spark.createDataFrame([(None, "abcdef"), (3, "uvwxyz"), (1, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == {
        None: hashlib.sha256(b"abcduv").hexdigest(), 3: hashlib.sha256(b"uvwx").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    shown = labels.filter("doc_id % 2 = 0")
    got = quality.judged(docs, shown, seed=1).select("doc_id", "_quality_kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["_quality_kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["_quality_kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_classifier_on_odd_rows(spark):
    docs = frame(spark, rows())
    some = spark.createDataFrame([(3, 1, 0), (10, 0, 0), (None, 1, 0), (17, None, None), (24, 1, None), (24, 1, 1), (31, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, some)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert quality.judged(docs, some.limit(0)).filter("NOT _quality_kept").count() == 0
    assert quality.judged(empty(spark), some).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "FETCHED", 5)
    values = [float((i * 7919) % 1009) for i in range(500)] + [3.5] * 200
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 300, 699, 700):
        assert quality.kth_largest(df, F.col("v"), k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, F.col("v"), 701) is None


def test_prose_is_what_the_corpus_says():
    import random

    assert len(prose(random.Random(1), 5).split(" ")) == 5
