"""Removal of long byte strings that occur in an earlier document, by run-length indexes of what is repeated.

A string of ``span`` bytes always has the same anchor: of its 20-byte substrings the one with the least hash, the first on ties.
The strings of a document that share an anchor lie in a row; together they are a piece of the text, and each string belongs to one
piece only. So two documents share a string only if they share its anchor, and pieces are dealt to buckets by their anchor's hash.
Documents lie in chunks of bounded size, by their id, in a bucketed table, so that their texts are shuffled once. What goes between
chunks and buckets has one entry per chunk, however many copies there are:

1. chunks send their anchors' hashes, buckets return those of several documents;
2. chunks send, for these, a hash of each different piece and its smallest document; buckets return the smallest document of all,
   and ask for the text of one copy of each piece whose anchor has different pieces, if one of another document continues alike:
   a string's bytes beside its anchor lie left and right of it in some shares, so pieces that share a string agree in one of
   ``SIDES`` stretches around the anchor;
3. chunks send those texts; a bucket builds a run-compressed Burrows-Wheeler index of them, streams the matching statistics of
   the pieces that an earlier document continues alike through it, and returns the strings of a piece whose smallest occurrence lies in an earlier document;
4. chunks remove: a piece that an earlier document has too goes whole, one that is its document's own loses the strings found.

Every string is judged on the input. A piece is identified by 96 bits of hashes. Nulls: a null text is empty; a null ``doc_id``
counts as the largest. Rows with one id are one document for the order and lie in one chunk. An empty table gives no rows. Extra
columns are carried along; ``_dedup`` names are taken.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.llm.common import give_back, mixed, parts_for, stored, utf8
from stratafold.llm.run_index import RunIndex
from stratafold.llm.tokens import forget
from stratafold.llm.words import slices
from stratafold.session import shared_path

ANCHOR = 20
CHUNK_BYTES = 8 << 20
#: Chunks per bucket of anchors, where there are more than ``LEAST_BUCKETS`` chunks: an exchange has a row per chunk and bucket.
PER_BUCKET, LEAST_BUCKETS = 8, 64
#: Stretches around an anchor of which pieces that share a string have one in common.
SIDES = 3
_PLACE_BITS = 28
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Text bytes of which pieces are made at once, so that the arrays stay in a processor's cache.
SLICE = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) <= n:
        _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * SLICE), base, np.uint64)]), dtype=np.uint64)
    return _POWERS[base][: n + 1]


def _stretches(span: int) -> list[tuple[int, int]]:
    """Bytes left and right of an anchor: any string of ``span`` bytes around it holds one of these stretches whole."""
    need = span - ANCHOR
    cuts = [round(i * (need + 1) / SIDES) for i in range(SIDES + 1)]
    return [(low, need + 1 - high) for low, high in zip(cuts, cuts[1:], strict=False)]


def _no_pieces():
    return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros((0, SIDES), np.uint32)]


def _slice_pieces(data: np.ndarray, limits: np.ndarray, span: int, sides: bool):
    n = len(data)
    if n < span:
        return _no_pieces()
    powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    kmers = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (kmers & ~low) | (np.arange(len(kmers), dtype=np.uint64) & low)
    width, have = span - ANCHOR + 1, 1
    while have < width:  # minimum over `width` places, by overlapping halves
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    windows = np.arange(len(key))
    doc = np.searchsorted(limits, windows, "right") - 1
    whole = windows + span <= limits[doc + 1]
    anchor = (key & low).astype(np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh & whole)
    if not len(first):
        return _no_pieces()
    stop = np.flatnonzero(np.concatenate([fresh[1:] | ~whole[1:], [True]]) & whole)
    at = anchor[first]
    size = stop + span - first
    text = (sums[first + size] - sums[first]) * inverse[first]
    around = np.zeros((len(first), SIDES), np.uint32)
    if sides:
        for i, (left, right) in enumerate(_stretches(span)):
            inside = np.flatnonzero((at - left >= first) & (at + ANCHOR + right <= stop + span))
            begin, end = at[inside] - left, at[inside] + ANCHOR + right
            around[inside, i] = (mixed((sums[end] - sums[begin]) * inverse[begin]) >> np.uint64(32)) | np.uint64(1)
    return doc[first], first, stop, kmers[at], mixed(text ^ (size.astype(np.uint64) << np.uint64(48))), around


def pieces(data: np.ndarray, limits: np.ndarray, span: int, sides: bool = False):
    """Per piece: text number, first and last start of its strings, hash of its anchor, hash of its bytes, and with ``sides`` hashes of the
    stretches around its anchor, 0 for one that it does not hold whole."""
    found = []
    for a, b in slices(limits, SLICE):
        doc, first, stop, anchor, text, around = _slice_pieces(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a], span, sides)
        found.append((doc + a, first + limits[a], stop + limits[a], anchor, text, around))
    if not found:
        return _no_pieces()
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(32)).astype(np.uint32)


def _combined(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(anchor, buckets).astype(np.uint64) << np.uint64(32)) | _short(anchor)


def _texts(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and limits, after what earlier chunks have left is given back: workers live on and would keep it."""
    forget()
    give_back()
    return utf8(chunk["text"])


def _ids(chunk: pa.Table) -> np.ndarray:
    return chunk["doc_id"].cast(pa.int64()).combine_chunks().fill_null(_LAST).to_numpy()


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether values are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _split(table: dict[str, np.ndarray], by: np.ndarray, key: str, fixed: dict[str, int]) -> pa.Table:
    """One row per value of ``by``, which is sorted: the arrays' parts as bytes."""
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    limits = np.append(first, len(by)).tolist()
    columns = {key: pa.array(by[first], pa.int32()) if len(by) else pa.array([], pa.int32())}
    columns |= {k: pa.array([v] * len(first), pa.int32()) for k, v in fixed.items()}
    columns |= {k: pa.array([v[a:b].tobytes() for a, b in zip(limits, limits[1:], strict=False)], pa.binary()) for k, v in table.items()}
    return pa.table(columns)


def _least(piece: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pieces with their smallest document and its index."""
    order = np.lexsort((owner, piece))
    first = np.ones(len(order), bool)
    first[1:] = piece[order][1:] != piece[order][:-1]
    at = order[first]
    return piece[at], owner[at], at


def _shared_anchors(rows: pa.Table) -> pa.Table:
    give_back()
    anchors, several = _joined(rows["anchors"], np.uint32), _joined(rows["several"], np.uint8)
    sizes = np.array([len(x) // 4 for x in rows["anchors"].to_pylist()])
    order = np.argsort(anchors, kind="stable")
    value = anchors[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(first, len(value)))
    many = (count > 1) | (np.maximum.reduceat(several[order], first) > 0)
    shared = np.empty(len(value), bool)
    shared[order] = np.repeat(many, count)
    chunk = np.repeat(rows["_dedup_chunk"].to_numpy(), sizes)
    return _split({"anchors": anchors[shared]}, chunk[shared], "_dedup_chunk", {"bucket": rows["bucket"][0].as_py()}).select(["_dedup_chunk", "bucket", "anchors"])


def _of_several(anchor: np.ndarray, side: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether pieces of different documents have the piece's anchor and what is beside it, and whether one of them is of an earlier document.

    Neither where the piece has too little beside its anchor (0).
    """
    key = (anchor.astype(np.uint64) << np.uint64(32)) | side
    order = np.argsort(key, kind="stable")
    order = order[side[order] > 0]
    several, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        each = np.diff(np.append(first, len(order)))
        least, most = (np.repeat(f.reduceat(owner[order], first), each) for f in (np.minimum, np.maximum))
        several[order], later[order] = least < most, least < owner[order]
    return several, later


def _smallest_owners(rows: pa.Table) -> pa.Table:
    give_back()
    piece, anchor, owner = (_joined(rows[c], k) for c, k in (("piece", np.uint64), ("anchor", np.uint32), ("owner", np.int64)))
    chunk = np.repeat(rows["_dedup_chunk"].to_numpy(), [len(x) // 8 for x in rows["piece"].to_pylist()])
    names, owners, at = _least(piece, owner)
    smallest = owners[np.searchsorted(names, piece)]
    kinds = np.sort(anchor[at])
    varied = np.unique(kinds[1:][kinds[1:] == kinds[:-1]])  # anchors with different pieces
    around = _joined(rows["around"], np.uint32).reshape(-1, SIDES)
    asked, searched = np.zeros(len(piece), bool), np.zeros(len(piece), bool)
    some = at[_within(anchor[at], varied)]
    for i in range(SIDES):
        several, later = _of_several(anchor[some], around[some, i], owner[some])
        asked[some] |= several
        searched[some] |= later
    out = []
    for kind, some in ((0, smallest < owner), (1, searched), (3, asked & ~searched)):
        order = np.flatnonzero(some)
        order = order[np.argsort(chunk[order], kind="stable")]
        out.append(_split({"piece": piece[order], "owner": smallest[order], "windows": np.zeros((len(order), 2), np.int32)}, chunk[order], "_dedup_chunk", {"kind": kind}))
    return pa.concat_tables(out).select(["_dedup_chunk", "kind", "piece", "owner", "windows"])


def _earlier_strings(span: int):
    def find(rows: pa.Table) -> pa.Table:
        give_back()
        piece, owner, size, searched = (_joined(rows[c], k) for c, k in (("piece", np.uint64), ("owner", np.int64), ("size", np.int32), ("searched", np.uint8)))
        chunk = np.repeat(rows["_dedup_chunk"].to_numpy(), [len(x) // 8 for x in rows["piece"].to_pylist()])
        blob = b"".join(rows["text"].to_pylist())
        limits = np.concatenate([[0], np.cumsum(size)]).tolist()
        strings = [blob[a:b] for a, b in zip(limits, limits[1:], strict=False)]
        index = RunIndex(strings)
        heads, _ = index.intervals(span)
        smallest = np.minimum.reduceat(owner[index.string[index.order]], heads)
        who = np.flatnonzero(searched)
        starts, lengths, row = index.statistics([strings[i] for i in who.tolist()], span)
        of = np.repeat(np.arange(len(who)), size[who])
        piece, owner, chunk = piece[who], owner[who], chunk[who]
        found = (lengths >= span) & (smallest[np.searchsorted(heads, row, "right") - 1] < owner[of])
        edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]) & found & np.concatenate([[False], found[:-1]])) if len(of) else np.zeros(0, np.int64)
        first = np.union1d(np.flatnonzero(edge[:-1] == 1), cut)
        last = np.union1d(np.flatnonzero(edge[1:] == -1), cut - 1)
        own = of[first]
        windows = np.stack([first - starts[own], last - starts[own]], 1).astype(np.int32)
        order = np.argsort(chunk[own], kind="stable")
        return _split({"piece": piece[own][order], "owner": owner[own][order], "windows": windows[order]}, chunk[own][order], "_dedup_chunk", {"kind": 2}).select(
            ["_dedup_chunk", "kind", "piece", "owner", "windows"])

    return find


def without_earlier(docs: DataFrame, span: int = 50, whole_characters: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``_dedup_bytes``, ``_dedup_removed``, ``_dedup_spans`` and ``_dedup_kept``, the bytes that remain.

    With ``whole_characters`` a character goes only if all its bytes do, so what remains is text.
    """
    spark, columns = docs.sparkSession, docs.columns
    chunks = parts_for(docs, "text", chunk_bytes)
    buckets = max(min(chunks, LEAST_BUCKETS), -(-chunks // PER_BUCKET))
    doc_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    placed = docs.withColumn("_dedup_chunk", F.pmod(F.xxhash64(doc_key), F.lit(chunks)).cast("int"))
    name = f"dedup_{uuid.uuid4().hex}"
    placed.repartition(chunks, "_dedup_chunk").write.format("parquet").bucketBy(chunks, "_dedup_chunk").sortBy("_dedup_chunk").option(
        "path", shared_path(spark, "chunks")).saveAsTable(name)
    held = spark.table(name)
    texts = held.select("_dedup_chunk", "doc_id", "text")

    def anchors(chunk: pa.Table) -> pa.Table:
        doc, _, _, anchor, _, _ = pieces(*_texts(chunk), span)
        both = _combined(anchor, buckets)
        order = np.lexsort((doc, both))
        both, doc = both[order], doc[order]
        fresh = np.ones(len(both), bool)
        fresh[1:] = both[1:] != both[:-1]
        first = np.flatnonzero(fresh)
        other = np.concatenate([[False], (doc[1:] != doc[:-1]) & ~fresh[1:]]) if len(both) else np.zeros(0, bool)
        several = np.logical_or.reduceat(other, first) if len(first) else np.zeros(0, bool)
        both = both[first]
        return _split({"anchors": both.astype(np.uint32), "several": several.astype(np.uint8)}, (both >> np.uint64(32)).astype(np.int64), "bucket",
                      {"_dedup_chunk": chunk["_dedup_chunk"][0].as_py()} if chunk.num_rows else {})

    sent = texts.groupBy("_dedup_chunk").applyInArrow(anchors, "bucket int, _dedup_chunk int, anchors binary, several binary")
    shared = stored(sent.groupBy("bucket").applyInArrow(_shared_anchors, "_dedup_chunk int, bucket int, anchors binary"), "anchors")

    def described(chunk: pa.Table, back: pa.Table) -> pa.Table:
        if not chunk.num_rows or not back.num_rows:
            return pa.table({c: pa.array([], pa.int32() if c in ("bucket", "_dedup_chunk") else pa.binary()) for c in ("bucket", "_dedup_chunk", "piece", "anchor", "owner", "around")})
        some = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32) for b, x in zip(back["bucket"].to_pylist(), back["anchors"].to_pylist(), strict=True)]))
        doc, _, _, anchor, piece, around = pieces(*_texts(chunk), span, True)
        mine = np.flatnonzero(_within(_combined(anchor, buckets), some))
        names, owner, at = _least(piece[mine], _ids(chunk)[doc[mine]])
        anchor, around = anchor[mine][at], around[mine][at]
        bucket = _bucket(anchor, buckets)
        order = np.argsort(bucket, kind="stable")
        return _split({"piece": names[order], "anchor": _short(anchor)[order], "owner": owner[order], "around": around[order]}, bucket[order], "bucket", {"_dedup_chunk": chunk["_dedup_chunk"][0].as_py()}).select(
            ["bucket", "_dedup_chunk", "piece", "anchor", "owner", "around"])

    by_chunk = lambda back: texts.groupBy("_dedup_chunk").cogroup(back.groupBy("_dedup_chunk"))
    told = by_chunk(shared).applyInArrow(described, "bucket int, _dedup_chunk int, piece binary, anchor binary, owner binary, around binary")
    verdict = "_dedup_chunk int, kind int, piece binary, owner binary, windows binary"
    owners = stored(told.groupBy("bucket").applyInArrow(_smallest_owners, verdict), "owners")

    def text_of(chunk: pa.Table, back: pa.Table) -> pa.Table:
        if not chunk.num_rows or not back.num_rows:
            return pa.table({c: pa.array([], pa.int32() if c in ("bucket", "_dedup_chunk") else pa.binary()) for c in ("bucket", "_dedup_chunk", "piece", "owner", "size", "searched", "text")})
        asked = np.sort(_joined(back["piece"], np.uint64))
        searched = np.sort(_joined(back.filter(pa.array(back["kind"].to_numpy() == 1))["piece"], np.uint64))
        data, limits = _texts(chunk)
        doc, first, stop, anchor, piece, _ = pieces(data, limits, span)
        mine = np.flatnonzero(_within(piece, asked))
        names, owner, at = _least(piece[mine], _ids(chunk)[doc[mine]])
        at = mine[at]
        bucket = _bucket(anchor[at], chunks)
        order = np.argsort(bucket, kind="stable")
        at, names, owner, bucket = at[order], names[order], owner[order], bucket[order]
        size = (stop[at] + span - first[at]).astype(np.int32)
        raw = data.tobytes()
        texts = [raw[a:a + s] for a, s in zip(first[at].tolist(), size.tolist(), strict=True)]
        out = _split({"piece": names, "owner": owner, "size": size, "searched": _within(names, searched).astype(np.uint8)}, bucket, "bucket", {"_dedup_chunk": chunk["_dedup_chunk"][0].as_py()})
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
        return out.append_column("text", pa.array([b"".join(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)], pa.binary())).select(
            ["bucket", "_dedup_chunk", "piece", "owner", "size", "searched", "text"])

    asked = by_chunk(owners.filter("kind IN (1, 3)")).applyInArrow(text_of, "bucket int, _dedup_chunk int, piece binary, owner binary, size binary, searched binary, text binary")
    strings = stored(asked.groupBy("bucket").applyInArrow(_earlier_strings(span), verdict), "strings")
    made = [("_dedup_bytes", T.LongType()), ("_dedup_removed", T.LongType()), ("_dedup_spans", T.LongType()), ("_dedup_kept", T.BinaryType())]
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema], *[T.StructField(n, t) for n, t in made]])

    def removed(chunk: pa.Table, back: pa.Table) -> pa.Table:
        data, limits = _texts(chunk)
        doc, first, stop, _, piece, _ = pieces(data, limits, span)
        own = _ids(chunk)[doc]
        names, owner, _ = _least(piece, own)
        kinds = back["kind"].to_numpy()
        some = {k: back.filter(pa.array(kinds == k)) for k in (0, 2)}
        sent, smaller = _joined(some[0]["piece"], np.uint64), _joined(some[0]["owner"], np.int64)
        owner = owner.copy()
        owner[np.searchsorted(names, sent)] = smaller
        number = np.searchsorted(names, piece)
        whole = owner[number] < own
        mark = np.zeros(len(data) + 1, np.int16 if span < 1 << 13 else np.int32)  # a byte lies in at most ``span`` pieces
        np.add.at(mark, first[whole], 1)
        np.add.at(mark, stop[whole] + span, -1)
        part, windows = _joined(some[2]["piece"], np.uint64), _joined(some[2]["windows"], np.int32).reshape(-1, 2)
        if len(part):
            order = np.argsort(part, kind="stable")
            part, windows = part[order], windows[order]
            mine = np.flatnonzero(~whole)
            low, high = np.searchsorted(part, piece[mine], "left"), np.searchsorted(part, piece[mine], "right")
            mine, each = np.repeat(mine, high - low), high - low
            at = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            np.add.at(mark, first[mine] + windows[at, 0], 1)
            np.add.at(mark, first[mine] + windows[at, 1] + span, -1)
        gone = np.cumsum(mark[:-1], dtype=mark.dtype, out=mark[:-1]) > 0
        del mark
        if whole_characters and len(data):  # a byte that stays keeps its character: of four bytes at most, so three steps either way
            inner = (data[1:] & 0xC0) == 0x80
            stays = np.logical_not(gone, out=gone)
            for _ in range(3):
                stays[1:] |= stays[:-1] & inner
            for _ in range(3):
                stays[:-1] |= stays[1:] & inner
            gone = np.logical_not(stays, out=stays)
            del inner, stays
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[limits[:-1][limits[:-1] < len(data)]] = gone[limits[:-1][limits[:-1] < len(data)]]
        filled = np.flatnonzero(limits[1:] > limits[:-1])

        def total(x):
            out = np.zeros(len(limits) - 1, np.int64)
            if len(filled):
                out[filled] = np.add.reduceat(x, limits[filled], dtype=np.int64)
            return out

        taken, spans = total(gone), total(begins)
        del begins
        kept_limits = np.concatenate([[0], np.cumsum(np.diff(limits) - taken)])
        kept = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(kept_limits.astype(np.int64)), pa.py_buffer(data[np.logical_not(gone, out=gone)])])
        table = chunk.select(columns)
        for (n, _), values in zip(made, (pa.array(np.diff(limits)), pa.array(taken), pa.array(spans), kept.cast(pa.binary())), strict=True):
            table = table.append_column(n, values)
        return table

    back = owners.filter("kind = 0").unionByName(strings)
    return held.groupBy("_dedup_chunk").cogroup(back.groupBy("_dedup_chunk")).applyInArrow(removed, out)
