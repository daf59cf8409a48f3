"""The pipeline's stages, each against brute force on what its predecessor kept."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import components, removed

import corpus_pipeline
from stratafold.llm import near, stages, suffix, tokens
from stratafold.llm.common import BATCH_BYTES, stored
from stratafold.llm.tokens import default_vocabulary, encoder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_are_those_of_documents(kept):
    assert all(d.dtypes == kept[0].dtypes for d in kept)


def test_classifier_rejects_bad_and_keeps_good(spark, kept):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = {r["doc_id"] for r in kept[1].select("doc_id").collect()}
    for r in labels.collect():
        if r["quality"] == 0 or r["toxic"] == 0:
            assert (r["doc_id"] in got) == (r["quality"] == 1)


def test_one_document_of_each_group_stays(kept):
    want = components(texts(kept[1]), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
    assert set(texts(kept[2])) == {k for k, (_, root) in want.items() if k == root}


def test_passages_stay_where_they_occur_first(kept):
    before, after = texts(kept[2]), texts(kept[3])
    for k, (size, gone, _, rest) in removed(before, corpus_pipeline.PASSAGE).items():
        if gone < size or not gone:
            left = after[k].encode()
            assert 0 <= len(left) - len(rest) <= 6 * max(1, gone // corpus_pipeline.PASSAGE)  # characters are not cut
        else:
            assert k not in after
    assert kept[3].filter("n_chars <> length(text)").count() == 0


def test_mix_takes_each_document_twice_at_most(kept):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before = {r["doc_id"]: (r["source"], words(r["text"])) for r in kept[3].collect()}
    taken = {}
    for r in kept[4].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + words(r["text"])
    assert all(n <= 2 * before[k][1] for k, n in taken.items())
    largest = {}
    for s, n in before.values():
        largest[s] = max(largest.get(s, 0), n)
    assert abs(sum(taken.values()) - 1.5 * sum(n for _, n in before.values())) <= sum(n / 2 + 1 for n in largest.values())
    assert set(kept[4].select("doc_id", "text").collect()) <= set(kept[3].select("doc_id", "text").collect())  # whole texts only


def test_packing_holds_every_token_once(spark, kept):
    pieces = corpus_pipeline.packed(spark, kept[4], FOLDER)
    r = pieces.agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"), F.countDistinct("sequence_id").alias("s")).first()
    first = pieces.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert r["n"] == first and r["m"] <= 1024 and r["n"] > 0.95 * 1024 * (r["s"] - 8)


LONG = " ".join(f"w{i}" for i in range(60))
ODD_ROWS = [
    (1, LONG, "a", "_"), (1, LONG, "a", "_"), (None, LONG + " end", "b", "_"), (None, "only here", "c", "_"), (None, "only here", "c", "_"),
    (2, LONG + " more", "d", "_"), (2, "unique text that no other row has", "e", "_"), (3, None, "f", "_"), (4, "", "g", "_"), (None, None, "h", "_"),
]


def test_rows_are_known_by_id_and_text(spark):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, SIZE string, _node string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in stages.one_of_each(docs, 5, 80).collect())
    assert got == sorted([("1", LONG), ("None", "only here"), ("2", "unique text that no other row has"), ("3", "None"), ("4", ""), ("None", "None")])


def test_stages_take_an_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, SIZE string, _node string")
    assert stages.one_of_each(docs.limit(0), 5, 80).count() == 0
    left = stages.without_passages(docs, 50)
    assert left.columns == docs.columns and {r["text"] for r in left.collect()} >= {None, "", "only here", LONG}


class Rows:
    """Gives the function that a worker would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def test_stages_that_encode_nothing_let_go_of_encoders(spark):
    encoder(default_vocabulary()).encode(["one two"])
    assert tokens._ENCODERS
    assert list(near.signatures(Rows(), 5)([])) == []
    assert not tokens._ENCODERS


def test_passages_let_go_of_encoders_and_give_room_back(monkeypatch):
    calls = []
    monkeypatch.setattr(suffix, "give_back", lambda: calls.append(1))
    encoder(default_vocabulary()).encode(["one two"])
    data, limits = suffix._texts(pa.table({"text": ["one", None]}))
    assert (data.tobytes(), limits.tolist()) == (b"one", [0, 3, 3])
    assert calls and not tokens._ENCODERS


@pytest.mark.parametrize("stage", [0, 1, 2, 4])
def test_workers_get_batches_of_bounded_size(spark, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.STAGES[stage][1](spark, docs, FOLDER)
    many = spark.range(9).crossJoin(docs).select("text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "rows"])

    found = many.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in found) == many.count() and len(found) > 1
    assert max(r["bytes"] for r in found) < 1.5 * BATCH_BYTES
    spark.conf.set(name, "65536")  # a smaller limit stays
    corpus_pipeline.packed(spark, docs, FOLDER)
    assert spark.conf.get(name).rstrip("b") == "65536"
    spark.conf.unset(name)
