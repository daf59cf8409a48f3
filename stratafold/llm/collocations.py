"""Collocations: phrases of two to four words that occur together more often than their parts apart, by direct-address tiles.

Words, then pairs, triples and quadruples are counted in one pass over the texts each. A pass knows the frequent units of the levels
below: the ``HEADS`` most frequent ones of a level by rank (a fixed bound, sent to every task), the others by their hash, which a bitmap
of fixed size lets through (a stray hash only costs a count that does not reach the least one). A phrase of n words is a pair again, of
the frequent unit of its first n - 1 words and the word behind it, whose own last n - 1 words must be frequent too; so each level is a
re-ranking of the frequent pairs of the level below.

In a task the pairs of ranks fall into square tiles of ``SIDE`` x ``SIDE``. Ranks go by frequency, so the tiles of small ranks are dense:
a tile with many pairs is an array addressed directly, counted by ``bincount``; the pairs of all other tiles, and those without ranks,
are sorted coordinate lists. What a task counted is added up by Spark on the pair, never on the tile, so that no task gets a hot tile.

All is per language: a word's hash holds its language. Hashes have 63 bits; two of N words or phrases share one with a
probability of N * N / 2^64. Spellings are looked up once at the end, for the words of the phrases that are left. The first ``most``
phrases are the feature; they are cut inside each task before they meet.

Nulls: a null text is empty, a null language is ``und``. Texts without words add nothing. Repeated rows count as often as they occur.
An empty table gives no rows. Extra columns are ignored. Equal scores go by count, then by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import mixed, stored, utf8
from stratafold.llm.words import lowered, slices

#: Units of a level that have ranks in the tasks; side of a tile; pairs of a tile from which it is an array.
HEADS, SIDE, DENSE = 1 << 19, 1 << 10, 1 << 17
#: Bits of the map of frequent units without a rank.
MAP_BITS = 24
#: Pairs or words that a task holds before it counts them.
HELD = 1 << 21
SLICE = 1 << 19

_POSITIVE = np.uint64((1 << 63) - 1)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
_GAP = _CUT.copy()
_GAP[[32, 9]] = True


def words_of(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, piece number, hash and first byte of each word in order; pieces are told apart across texts too."""
    n = len(data)
    first = np.zeros(n, bool)
    first[limits[:-1][limits[:-1] < n]] = True
    inside = ~_GAP[data]
    begins = inside & first
    begins[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), starts)
    piece = np.cumsum(_CUT[data] | first)[starts]
    number = np.cumsum(begins)
    place = np.where(inside, np.arange(n) - starts[np.maximum(number, 1) - 1], 0)
    weight = mixed(np.arange(1, int(place.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    worth = np.where(inside, weight[place] * (data.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    return np.searchsorted(limits, starts, "right") - 1, piece, mixed(np.add.reduceat(worth, starts)), starts


def _language_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A hash per row, the row's language number, and the languages."""
    filled = pa.array(column).cast(pa.string()).fill_null("und").dictionary_encode()
    names = filled.dictionary.to_pylist()
    index = filled.indices.to_numpy(zero_copy_only=False)
    return _tongues(names).view(np.uint64)[index], index, names


def _tongues(names: list[str]) -> np.ndarray:
    """A number for each of these languages."""
    return np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True) for name in names] or [0], np.int64)


def _texts(batch: pa.RecordBatch):
    """Per slice of a batch: words as ``words_of`` gives them with hashes that hold the language, the bytes, limits and language numbers."""
    data, limits = utf8(batch["text"])
    language, index, names = _language_hashes(batch["lang"])
    for a, b in slices(limits, SLICE):
        own, bounds = lowered(data[limits[a]:limits[b]]), limits[a:b + 1] - limits[a]
        doc, piece, hashes, starts = words_of(own, bounds)
        yield doc, piece, (mixed(hashes ^ language[a:b][doc]) & _POSITIVE).view(np.int64), starts, own, bounds, index[a:b], names


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (mixed(mixed(left.view(np.uint64) * _LEFT) + right.view(np.uint64) * _RIGHT) & _POSITIVE).view(np.int64)


@dataclass
class Units:
    """The frequent units of a level as tasks know them: ranks of the most frequent, a bitmap of the others' keys."""

    keys: np.ndarray  # by rank
    ordered: np.ndarray
    ranks: np.ndarray  # of the ordered keys
    bitmap: np.ndarray | None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (ranks, or -1 - key) and which of the keys are units at all."""
        ids, known = -1 - keys, np.zeros(len(keys), bool)
        if len(self.keys) and len(keys):
            at = np.searchsorted(self.ordered, keys)
            at[at == len(self.keys)] = 0
            known = self.ordered[at] == keys
            ids[known] = self.ranks[at[known]]
        if self.bitmap is not None:
            slot = keys >> (63 - MAP_BITS)
            known |= (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        return ids, known

    def keys_of(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return -1 - ids
        return np.where(ids >= 0, self.keys[np.maximum(ids, 0)], -1 - ids)


def units_of(frequent: DataFrame, heads: int = HEADS) -> Units:
    """``frequent`` (key, n) as tasks know it. Ranks go to the counts from a limit on, of which there are ``heads`` at most."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2("n"))).cast("long")
    total, least, rows = 0, None, frequent.groupBy(level.alias("v")).count().collect()  # a few thousand values of the level
    for row in sorted(rows, reverse=True):
        if total + row["count"] > heads:
            break
        total, least = total + row["count"], row["v"]
    top = frequent.filter(level >= least).select("key", "n").toArrow().to_pandas() if least is not None else None
    keys = np.zeros(0, np.int64) if top is None else top.sort_values(["n", "key"], ascending=[False, True])["key"].to_numpy(np.int64)
    bitmap = None
    rest = frequent if least is None else frequent.filter(level < least)
    if total < sum(r["count"] for r in rows):
        slot = F.shiftright("key", 63 - MAP_BITS)
        words = rest.select(F.shiftright(slot, 5).alias("w"), F.expr(f"shiftleft(1L, cast(shiftright(key, {63 - MAP_BITS}) & 31 as int))").alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()  # 2^19 rows at most
        whole = np.zeros(1 << (MAP_BITS - 5), "<u4")
        whole[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).astype(np.uint32)
        bitmap = whole.view(np.uint8)
    ranks = np.argsort(keys)
    return Units(keys, keys[ranks], ranks, bitmap)


def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of ids and how often they occur: dense tiles by address, the others as sorted coordinates."""
    out = []
    ranked = (left >= 0) & (right >= 0)
    a, b = left[ranked], right[ranked]
    if len(a):
        across = int(b.max()) // SIDE + 1
        tile = a // SIDE * across + b // SIDE
        filled = np.bincount(tile)
        sparse = np.ones(len(a), bool)
        for t in np.flatnonzero(filled >= DENSE):
            here = tile == t
            sparse &= ~here
            n = np.bincount(a[here] % SIDE * SIDE + b[here] % SIDE, minlength=SIDE * SIDE)
            cell = np.flatnonzero(n)
            out.append((t // across * SIDE + cell // SIDE, t % across * SIDE + cell % SIDE, n[cell]))
        cell, n = np.unique((a[sparse] << 32) | b[sparse], return_counts=True)
        out.append((cell >> 32, cell & ((1 << 32) - 1), n))
    a, b = left[~ranked], right[~ranked]
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out.append((a[new], b[new], np.diff(np.append(new, len(a)))))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out))


def word_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``key, n, tongue`` of the frequent words, the last for their language, and ``lang, n`` of all word occurrences."""
    def count(batches):
        held, size, languages = [], 0, {}

        def told():
            keys, n, tongue = (np.concatenate([part[i] for part in held]) if held else np.zeros(0, np.int64) for i in range(3))
            order = np.argsort(keys)
            keys, n, tongue = keys[order], n[order], tongue[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[new], np.add.reduceat(n, new) if len(keys) else n, tongue[new]

        def sent(keys, n, tongue):
            return pa.record_batch([pa.array(keys), pa.nulls(len(keys), pa.string()), pa.array(n.astype(np.int64)), pa.array(tongue)], names=["key", "lang", "n", "tongue"])

        for batch in batches:
            for doc, _, keys, _, _, _, index, names in _texts(batch):
                new, at, n = np.unique(keys, return_index=True, return_counts=True)
                held.append((new, n, _tongues(names)[index[doc[at]]]))
                size += len(new)
                for i, c in enumerate(np.bincount(index[doc], minlength=len(names))):
                    languages[names[i]] = languages.get(names[i], 0) + int(c)
                if size > HELD:
                    held = [told()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield sent(*held.pop())
                        size = 0
        yield sent(*told())
        yield pa.record_batch([pa.nulls(len(languages), pa.int64()), pa.array(list(languages), pa.string()), pa.array(list(languages.values()), pa.int64()),
                               pa.nulls(len(languages), pa.int64())], names=["key", "lang", "n", "tongue"])

    sums = docs.mapInArrow(count, "key long, lang string, n long, tongue long").groupBy("key", "lang").agg(F.sum("n").alias("n"), F.min("tongue").alias("tongue"))
    found = stored(sums.filter(F.col("lang").isNotNull() | (F.col("n") >= least)), "words")
    return found.filter("key IS NOT NULL").select("key", "n", "tongue"), found.filter("lang IS NOT NULL").select("lang", "n")


def longer(docs: DataFrame, levels: list[Units], least: int) -> DataFrame:
    """``key, left, right, n`` of the frequent phrases that are one word longer than the last level's.

    Pairs are shuffled by the ids of their parts; only the frequent ones get keys.
    """
    known = docs.sparkSession.sparkContext.broadcast(levels)

    def pairs(batches):
        levels = known.value
        n = len(levels) + 1

        def sent(held):
            left, right, count = counted(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            return pa.record_batch([pa.array(left), pa.array(right), pa.array(count.astype(np.int64))], names=["left", "right", "n"])

        held, size = [], 0
        for batch in batches:
            for _, piece, keys, *_ in _texts(batch):
                words, is_word = levels[0].find(keys)
                units, is_unit = words, is_word
                for m in range(1, n - 1):  # units of m + 1 words, by their first word
                    whole = len(keys) - m
                    if whole <= 0:
                        break
                    may = np.flatnonzero(is_unit[:whole] & is_word[m:] & (piece[:whole] == piece[m:]))
                    found, known_here = levels[m].find(pair_keys(levels[m - 1].keys_of(units[may]), keys[m:][may]))
                    units, is_unit = np.zeros(whole, np.int64), np.zeros(whole, bool)
                    units[may], is_unit[may] = found, known_here
                whole = len(keys) - n + 1
                if whole <= 0:
                    continue
                at = np.flatnonzero(is_unit[:whole] & is_unit[1:whole + 1] & is_word[n - 1:] & (piece[:whole] == piece[n - 1:]))
                held.append((units[at], words[at + n - 1]))
                size += len(at)
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def keyed(batches):
        levels = known.value
        for batch in batches:
            left, right = (batch[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
            a, b = levels[-1].keys_of(left), levels[0].keys_of(right)
            yield pa.record_batch([pa.array(pair_keys(a, b)), pa.array(a), pa.array(b), batch["n"]], names=["key", "left", "right", "n"])

    made = docs.mapInArrow(pairs, "left long, right long, n long")
    frequent = made.groupBy("left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stored(frequent.mapInArrow(keyed, "key long, left long, right long, n long"), "phrases")


def spellings(docs: DataFrame, wanted: Units) -> DataFrame:
    """``key, lang, word`` of the wanted words."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def spell(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for doc, _, keys, starts, data, limits, index, names in _texts(batch):
                new, at = np.unique(keys, return_index=True)
                fresh = known.value.find(new)[1] & ~np.isin(new, seen, assume_unique=True)
                new, at = new[fresh], at[fresh]
                seen = np.concatenate([seen, new])
                gap = np.append(np.flatnonzero(_GAP[data]), len(data))
                begin = starts[at]
                end = np.minimum(gap[np.searchsorted(gap, begin)], limits[doc[at] + 1])
                words = [data[s:e].tobytes().decode() for s, e in zip(begin, end)]
                yield pa.record_batch([pa.array(new), pa.array([names[i] for i in index[doc[at]]], pa.string()), pa.array(words, pa.string())], names=["key", "lang", "word"])

    return docs.mapInArrow(spell, "key long, lang string, word string").groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


def _scored(phrases: DataFrame, all_units: DataFrame) -> DataFrame:
    """``words, a, l, r, score`` of each phrase at the cut with the least score, the first of equals."""
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = phrases.select("words", F.col("n").alias("a"), k).withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn(
        "rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    both = cuts.join(all_units.toDF("first", "l"), "first").join(all_units.toDF("rest", "r"), "rest")
    score = F.expr("(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    both = both.withColumn("score", score)
    best = both.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("words", "a", "best.l", "best.r", "best.score")


def _contained(phrases: DataFrame) -> DataFrame:
    """``words, most``: the largest count of a longer phrase around them."""
    size = F.size("words")
    parts = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), s -> slice(words, s, m))))")
    return phrases.filter(size > 2).select(F.explode(parts).alias("words"), "n").groupBy("words").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, heads: int = HEADS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` best phrases of 2 to ``longest`` words with ``a >= least``."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    frequent, totals = word_counts(texts, least)
    levels, units = [units_of(frequent, heads)], [frequent.select(F.array("key").alias("words"), "n", "key")]
    for _ in range(2, longest + 1):
        found = longer(texts, levels, least)
        levels.append(units_of(found.select("key", "n"), heads))
        words = units[-1].select(F.col("key").alias("left"), F.col("words"))
        units.append(stored(found.join(words, "left").select(F.concat("words", F.array("right")).alias("words"), "n", "key"), "units"))
    whole = units[0]
    for u in units[1:]:
        whole = whole.unionByName(u)
    phrases = units[1]
    for u in units[2:]:
        phrases = phrases.unionByName(u)
    counts = whole.select("words", "n")
    kept = _scored(phrases, counts).join(_contained(phrases), "words", "left").filter("most IS NULL OR 100 * CAST(most AS DECIMAL(20, 0)) < 80 * CAST(a AS DECIMAL(20, 0))")
    # Only phrases that may be among the first need spellings; what ties with the last of them by score and count stays.
    place = F.rank().over(Window.partitionBy("tongue").orderBy(F.desc("score"), F.desc("a")))
    told = kept.drop("most").withColumn("key", F.get("words", F.lit(0))).join(frequent.select("key", "tongue"), "key").withColumn("_place", place)
    kept = stored(told.filter(F.col("_place") <= most).select("words", "a", "l", "r", "score"), "kept")
    used = kept.select(F.explode("words").alias("key")).distinct().withColumn("n", F.lit(1).cast("long"))
    spelled = stored(spellings(texts, units_of(used, heads)), "spelled")
    spread = kept.select("words", "a", "l", "r", "score", F.posexplode("words").alias("i", "key")).join(spelled, "key")
    named = spread.groupBy("words", "a", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = named.withColumn("rank", rank).filter(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
