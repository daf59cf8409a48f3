"""Token files and packing against the tokenizer itself, called once per text."""

import zlib

import numpy as np
import pytest
from llm_corpus import SCHEMA, empty, frame, rows
from pyspark.sql import functions as F

from stratafold.llm import packing, token_files
from stratafold.llm.common import stored
from stratafold.llm.tokens import Encoder, default_vocabulary, encoder
from stratafold.session import shared_path


def ids_of(text, end):
    library = encoder(default_vocabulary()).library
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("text", ["", " a", "a ", "a  b", "a   b", "x \n y", "x\n\n y\t z", "a\x1cb c", "  a　 b", "<|endoftext|> x", "don't 12 34", "   ", "\n", "a\n b\n  c", "x" * 5000])
def test_pieces_give_the_ids_of_the_whole_text(text):
    code = encoder(default_vocabulary())
    assert np.frombuffer(code.encode([text])[0], code.kind).tolist() == ids_of(text, 0).tolist()[:-1]


@pytest.mark.parametrize("text", ["a\n\u00a0\u00a0x", "intro\n\u00a0\u00a0- item one\n\u00a0\u00a0- item two", "end\n\u00a0", "a\n\t\tb", "a\n\u3000\n\u2003b", "a \u00a0\u00a0b\nc"])
def test_line_ends_before_white_space_give_the_ids_of_the_whole_text(text):
    code = encoder(default_vocabulary())
    assert np.frombuffer(code.encode([text])[0], code.kind).tolist() == ids_of(text, 0).tolist()[:-1]


def test_letters_go_to_the_model_without_the_search_for_cuts():
    text = "Thoningen hees.\nañade große ÿ, the hees; ªº µ Ereaeaor"
    want = ids_of(text, 0).tolist()[:-1]
    code = Encoder(default_vocabulary())
    code.encode(["a.\nb,\nc;"])  # signs and line ends
    code.library = None  # what needs the whole library fails
    assert np.frombuffer(code.encode([text])[0], code.kind).tolist() == want


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr("stratafold.llm.tokens.REMEMBERED", 3)
    monkeypatch.setattr("stratafold.llm.tokens.CHARACTERS", 20)
    code = Encoder(default_vocabulary())
    texts = ["the hees. the", "x  y\n\n z", "", "É! é. ɐ. 12; 3's.", "the hees, 漢字.", "<|endoftext|> the hees.", None, "漢字. the hees", "\nthe\n"]
    for _ in range(3):
        for text, made in zip(texts, code.encode(texts), strict=True):
            assert np.frombuffer(made, code.kind).tolist() == ids_of(text, 0).tolist()[:-1]


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "a\n <|endoftext|>\n b", "<|endoftext|>", "x  <|endoftext|>  y"])
def test_ids_are_those_of_the_library_as_it_comes(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    code, plain = encoder(default_vocabulary()), encoder(default_vocabulary(), plain_specials=True)
    assert np.frombuffer(code.encode([text])[0], code.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 not in np.frombuffer(plain.encode([text])[0], plain.kind)


def test_files_hold_every_text_in_order(spark):
    some = rows()
    files = stored(token_files.write_token_files(frame(spark, some), shared_path(spark, "t"), end_id=2, length=64), "m")
    got = {r["doc_id"]: r for r in token_files.read_documents(token_files.with_starts(files)).collect()}
    at = 0
    for doc_id, text in sorted((r[0], r[1]) for r in some):
        want = ids_of(text, 2)
        r = got.pop(doc_id)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert not got


def test_sequences_are_views_with_masks(spark):
    some = rows()
    files = stored(token_files.write_token_files(frame(spark, some), shared_path(spark, "t"), end_id=2, length=32), "m").orderBy("file").collect()
    stream = np.concatenate([ids_of(t, 2) for _, t in sorted((r[0], r[1]) for r in some)])
    found = []
    for f in files:
        file = token_files.TokenFile(f["path"])
        assert len(file) == f["sequences"]
        for i in range(len(file)):
            ids, mask = file[i]
            assert len(ids) == len(mask) == 32 and not ids.flags.owndata
            found.append(ids[mask])
    assert np.array_equal(np.concatenate(found), stream)


def test_null_and_repeated_ids_and_no_rows(spark):
    some = [(None, "b", *[None] * 6), (4, "a", *[None] * 6), (4, "a", *[None] * 6), (None, None, *[None] * 6)]
    files = stored(token_files.write_token_files(frame(spark, some), shared_path(spark, "t")), "m")
    got = token_files.read_documents(token_files.with_starts(files)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 4, 4]
    none = stored(token_files.write_token_files(empty(spark), shared_path(spark, "t")), "m")
    assert token_files.read_documents(token_files.with_starts(none)).count() == 0
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 40, 8), packing.Limits(128, 64, 128, 16), packing.Limits(64, 2, 64, 0)])
def test_packing_keeps_every_token_and_every_limit(spark, limits):
    some = [(i, t, s, o, n, *x) for i, t, s, o, n, *x in rows()]
    docs = frame(spark, some).withColumn("prompt", F.col("doc_id") % 9)
    pieces = packing.pack(docs, limits, end_id=0, prompt_tokens="prompt").collect()
    text = {r[0]: r[1] for r in some}
    per, sequences = {}, {}
    for p in pieces:
        want = ids_of(text[p["doc_id"]], 0)
        assert p["doc_tokens"] == len(want) and p["ids"] == want[p["start"]:p["start"] + p["length"]].tobytes()
        per.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(per) == set(text)
    for doc_id, own in per.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids_of(text[doc_id], 0))
    filled = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and at == own[0]["sequence_tokens"]
        assert own[0]["padded_to"] == (at if at & (at - 1) == 0 else limits.tokens)
        loss = sum(sum(1 for k in range(p["start"], p["start"] + p["length"]) if k >= p["doc_id"] % 9) for p in own)
        assert loss <= limits.loss_tokens
        filled += at
    if limits.cut_from and limits.segments == 64:
        assert filled > 0.95 * limits.tokens * (len(sequences) - 3)


def test_docs_schema_is_free(spark):
    assert packing.pack(spark.createDataFrame([(1, "a")], "doc_id int, text string")).first()["length"] == 2
    assert "key" in SCHEMA.fieldNames()
