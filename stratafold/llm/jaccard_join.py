"""Exact Jaccard join of documents' word n-grams, size-aware: small sets by their subsets, large sets over inverted lists.

Two sets of sizes a and b reach the similarity when they share ``needed(a, b)`` n-grams or more. For small sets that is all but a few:
each enumerates its subsets of every size that a partner may need, and sets that have a subset of the needed size in common are linked,
without any comparison. Large sets scan the inverted lists of their first ``size - least partner + 1`` n-grams, rare ones first; sets
that are linked share one of these. The boundary is the size at which both together cost least: the rows that enumeration makes, and
the rows and list entries that scanning reads, both summed from all sets of the corpus by size.

Equal sets are one class from the start. A list with m classes does not give m * m pairs:

1. every class meets the least of its list; pairs whose sizes and parity bitmaps allow it are confirmed on their full sets;
2. what the links join are components. Lists that still hold several components (one of those with the same members) are scanned, long
   ones in tiles: classes of different components are compared inside the task, first by bitmap, then on full sets, and a task
   tells only links that join components. A component that holds most of a list is dealt apart and not compared with itself.

The order of n-grams comes from a hashed table of their counts over all documents, of a fixed size; any order gives the same result, a
good one gives short lists. A parity bitmap turns a bit for each n-gram; the bits in which two differ are never more than the n-grams in
which the sets differ, so the test loses nothing. No list, partner or candidate is capped: the join is exact but for hashes (64 bits of
an n-gram; a class is known by 64 bits too).

Nulls: a null text is empty; a text without words has no n-grams and no links. A row without ``doc_id`` takes part, but does not name a
component unless there is no other row. Rows with one id and different texts are different nodes. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import mixed, one_by_one, stored, utf8
from stratafold.llm.words import distinct, grams, lowered, slices, word_hashes
from stratafold.operators.components import star_roots

#: Sizes up to which enumeration is weighed against scanning.
SMALL = 64
#: Words of 64 bits in a parity bitmap, classes of a tile, of a list that is short, and entries of short lists that a task takes at a time.
WORDS, TILE, SHORT, BIN = 16, 2048, 256, 1 << 15
#: Parts of a hot list, and keys that are sent to every task at most (16 bytes each).
SALTS, FEW = 64, 1 << 20
#: Buckets of the table of counts, and the size of sets from which bitmaps grow with the set.
BITS, LARGE = 19, 2000


def needed(a, b, percent: int):
    """Common n-grams that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def least_partner(a, percent: int):
    return -(-percent * a // 100)


@lru_cache(None)
def subset_sizes(size: int, percent: int) -> tuple[int, ...]:
    """Sizes of the subsets by which a set of ``size`` meets its partners, equal sets apart."""
    partners = range(max(1, least_partner(size, percent)), 100 * size // percent + 1)
    return tuple(sorted({needed(size, b, percent) for b in partners if b != size or needed(size, b, percent) < size}))


def subset_count(size: int, percent: int) -> int:
    return sum(comb(size, k) for k in subset_sizes(size, percent))


@lru_cache(256)
def _left_out(size: int, m: int) -> np.ndarray:
    """Every choice of ``m`` of ``size`` places, a row each."""
    return np.array(list(combinations(range(size), m)), np.int64).reshape(comb(size, m), m)


def subset_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and key of each subset of one set that a partner may need."""
    total, out, sizes = hashes.sum(dtype=np.uint64), [], []
    for k in subset_sizes(len(hashes), percent):
        left = _left_out(len(hashes), len(hashes) - k)
        sums = total - hashes[left].sum(1, dtype=np.uint64)
        out.append(mixed(sums ^ mixed(np.array([k], np.uint64))))
        sizes.append(np.full(len(sums), k, np.int32))
    return (np.concatenate(sizes), np.concatenate(out).view(np.int64)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def widths(size: np.ndarray) -> np.ndarray:
    """Words of the bitmaps of sets of these sizes: doubled with the size from ``LARGE`` on, so that large sets do not fill them."""
    return np.where(size > 0, WORDS << np.ceil(np.log2(np.maximum(size, LARGE) / LARGE)).astype(np.int64), 0)


def parities(doc: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words of all sets' parity bitmaps in a row."""
    width = widths(size)
    at = np.cumsum(width) - width
    bit = hashes & (64 * width[doc] - 1).astype(np.uint64)
    words = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(words, at[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words


def _sets(batch: pa.RecordBatch | pa.Table, n: int):
    """Per slice of a batch: its rows' range, and text number and n-grams of their sets in order."""
    data, limits = utf8(batch["text"])
    for a, b in slices(limits):
        yield a, b, *distinct(*grams(*word_hashes(lowered(data[limits[a]:limits[b]]), limits[a:b + 1] - limits[a]), n))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def rarity(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """How common the n-grams of each of ``2 ** BITS`` hash buckets are, on a scale of 256, and the level from which lists may be hot."""
    bits = BITS
    shift = np.uint64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, _, hashes in _sets(batch, n):
                total += np.bincount((hashes >> shift).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[i:i + (1 << 16)].astype(np.int32)), pa.array(total[at[i:i + (1 << 16)]])], names=["bucket", "n"])

    level = F.least(F.lit(255), F.floor(6 * F.log2(F.sum("n")))).cast("short")
    found = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(level.alias("level")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[found["bucket"].to_numpy()] = found["level"].to_numpy()
    middle = int(np.median(table[table > 0])) if len(found) else 0
    return table, max(6 * 17, middle + 12)  # 2^17 n-grams, and four times what most buckets have


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, key, size, d1, d2``, the parity ``bitmap``, the ``prefix`` by which a set is found in lists, the last ``hot`` of them in lists that may be long, and the whole of a ``small`` set."""
    known = docs.sparkSession.sparkContext.broadcast(rarity(docs, n))

    def sign(batches):
        common, hot = known.value
        shift = np.uint64(64 - int(np.log2(len(common))))
        for batch in batches:
            for a, b, doc, hashes in _sets(batch, n):
                size = np.bincount(doc, minlength=b - a)
                has = np.flatnonzero(size)
                digest = np.zeros((2, b - a), np.uint64)
                if len(has):
                    first = np.concatenate([[0], np.cumsum(size[has])[:-1]])
                    digest[0, has] = mixed(np.add.reduceat(hashes, first) + size[has].astype(np.uint64))
                    digest[1, has] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
                order = np.lexsort(((common[hashes >> shift].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8)), doc))
                place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                length = np.where(size > 0, size - least_partner(size, percent) + 1, 0)
                chosen = order[place < length[doc]]
                prefix = hashes[chosen]
                hots = np.bincount(doc[chosen][common[prefix >> shift] >= hot], minlength=b - a).astype(np.int32)
                little = (size <= SMALL)[doc]
                yield pa.record_batch([
                    batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                    _lists(parities(doc, hashes, size), widths(size)), _lists(prefix, length), pa.array(hots), _lists(hashes[little], np.where(size <= SMALL, size, 0)),
                ], names=["doc_id", "key", "size", "d1", "d2", "bitmap", "prefix", "hot", "small"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(sign, "doc_id long, key long, size long, d1 long, d2 long, bitmap array<long>, prefix array<long>, hot int, small array<long>")


def boundary(classes: DataFrame, percent: int) -> int:
    """The largest size of sets that enumerate their subsets: where enumeration up to it and scanning beyond it cost least together."""
    entries = classes.filter(F.col("size") <= SMALL).select("size", F.explode("prefix").alias("gram"))
    lists = entries.groupBy("gram").agg(F.count("*").alias("m"))
    scans = {r["size"]: r["n"] for r in entries.join(lists, "gram").groupBy("size").agg(F.sum(F.col("m") + 1).alias("n")).collect()}
    sets = {r["size"]: r["n"] for r in classes.filter(F.col("size") <= SMALL).groupBy("size").agg(F.count("*").alias("n")).collect()}
    best, spent, saved = (0, 0), 0, 0
    for size in range(1, SMALL + 1):
        spent += sets.get(size, 0) * subset_count(size, percent)
        saved += scans.get(size, 0)
        best = min(best, (spent - saved, size))
    return best[1]


def _small_links(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links ``a, b`` of sets up to ``limit``: each set with the smallest one that has the same subset, if that subset is large enough for both."""
    def enumerate_(batches):
        for batch in batches:
            rep, size = batch.column("rep").to_numpy(), batch.column("size").to_numpy()
            lists = batch.column("small")
            values, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(size)])
            for i in range(len(rep)):
                k, keys = subset_keys(values[at[i]:at[i + 1]], percent)
                if len(keys):
                    yield pa.record_batch([pa.array(np.full(len(keys), rep[i])), pa.array(np.full(len(keys), size[i])), pa.array(k), pa.array(keys)], names=["rep", "size", "k", "key"])

    rows = classes.filter(F.col("size") <= limit).select("rep", "size", "small").mapInArrow(enumerate_, "rep long, size long, k int, key long")
    least = rows.groupBy("k", "key").agg(F.min(F.struct("size", "rep")).alias("p"), F.count("*").alias("m")).filter("m > 1")
    both = rows.join(least, ["k", "key"]).filter((F.col("rep") != F.col("p.rep")) & (F.ceil(percent * (F.col("size") + F.col("p.size")) / (100 + percent)) <= F.col("k")))
    return both.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()


def _allowed(a, b, percent: int):
    """N-grams in which sets of these sizes may differ."""
    return a + b - 2 * needed(a, b, percent)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``p, rep`` whose sizes and bitmaps allow a link."""
    facts = classes.select("rep", "size", "bitmap")
    both = pairs.join(facts.toDF("p", "an", "abits"), "p").join(facts.toDF("rep", "bn", "bbits"), "rep")
    narrow = F.least(F.size("abits"), F.size("bbits"))

    def folded(bits: str):  # a bitmap of twice the width as that of the half: n-grams that fall together cancel as they would there
        halves = F.zip_with(F.slice(bits, F.lit(1), narrow), F.slice(bits, narrow + 1, narrow), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) == 2 * narrow, halves).otherwise(F.col(bits))

    apart = F.aggregate(F.zip_with(folded("abits"), folded("bbits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    least = F.ceil(percent * (F.col("an") + F.col("bn")) / (100 + percent))
    comparable = F.greatest(F.size("abits"), F.size("bbits")) <= 2 * narrow  # others are compared on full sets
    unlike = comparable & (apart > F.col("an") + F.col("bn") - 2 * least)
    return both.filter(~unlike).select("p", "rep")


def _met(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """``gram, rep, size, p`` of the lists with two classes or more, one of them over ``limit``; ``p`` is the least class.

    An entry whose neighbours by size are too small and too large for it has no partner in its list and leaves it, but in hot lists.

    The entries are shuffled once: what is counted per part of a list is joined back to the parts where they lie. Hot lists have
    ``SALTS`` parts, all others one.
    """
    at = classes.select("rep", "size", "hot", F.size("prefix").alias("many"), F.posexplode("prefix").alias("at", "gram"))
    salt = F.coalesce(F.when(F.col("at") >= F.col("many") - F.col("hot"), 1 + F.pmod("rep", F.lit(SALTS))).cast("int"), F.lit(0))  # without nulls, or the two readers' plans differ
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = at.select("gram", salt.alias("salt"), "rep", "size").repartition(parts, "gram", "salt")
    by_size = Window.partitionBy("gram", "salt").orderBy("size", "rep")
    some = (100 * F.lag("size").over(by_size) >= percent * F.col("size")) | (100 * F.col("size") >= percent * F.lead("size").over(by_size))
    entries = entries.withColumn("some", (F.col("salt") > 0) | F.coalesce(some, F.lit(False))).filter("some").drop("some")
    counted = entries.groupBy("gram", "salt").agg(F.min(F.struct("size", "rep")).alias("p"), F.max("size").alias("most"), F.count("*").alias("m")).filter("m > 1 OR salt > 0")
    lists = counted.groupBy("gram").agg(F.min("p").alias("p"), F.max("most").alias("most"), F.sum("m").alias("m"), F.collect_set("salt").alias("salts")).filter(
        (F.col("m") > 1) & (F.col("most") > limit))
    return entries.join(lists.select("gram", "p", F.explode("salts").alias("salt")), ["gram", "salt"]).select("gram", "rep", "size", "p")


def _once(batches):
    """Each key's text once per task, so that a row repeated any number of times does not travel as often."""
    seen: set[int] = set()
    for batch in one_by_one(batches):
        keys = batch["key"].to_pylist()
        at = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        yield batch.take(pa.array(at, pa.int64()))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` among pairs ``p, rep``, on full sets.

    Texts travel, not sets: those that ``p`` is compared with come in parts of about ``TILE``, each behind the text of ``p``. The rows of
    a part are streamed in that order, so a task holds the set of ``p`` and a batch of others.
    """
    parts = pairs.groupBy("p").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = stored(pairs.join(parts, "p").select("p", "rep", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part")), "dealt")
    heads = dealt.select("p", "part").distinct().select("p", F.col("p").alias("rep"), "part", F.lit(0).alias("side"))
    wanted = heads.unionByName(dealt.withColumn("side", F.lit(1))).join(classes.select("rep", "key"), "rep")
    wanted = stored(wanted, "wanted")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
        texts = texts.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
    unit = ["p", "part"]
    rows = texts.mapInArrow(_once, texts.schema).join(wanted, "key").select(*unit, "side", "rep", "text")
    placed = rows.repartition(*[F.col(c) for c in unit]).sortWithinPartitions(*unit, "side", "rep")

    def compare(batches):
        head = own = last = None
        for batch in one_by_one(batches):
            p, part, side, rep = (batch[c].to_pylist() for c in ("p", "part", "side", "rep"))
            found = []
            for a, b, doc, hashes in _sets(batch, n):
                limits = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(a, b):
                    mine = hashes[limits[i - a]:limits[i - a + 1]]
                    if side[i] == 0:
                        head, own, last = mine.copy(), (p[i], part[i]), None
                    elif own == (p[i], part[i]) and rep[i] != last:  # a repeated row follows its like
                        last = rep[i]
                        at = np.minimum(np.searchsorted(head, mine), len(head) - 1)
                        common = int((head[at] == mine).sum())
                        if 100 * common >= percent * (len(head) + len(mine) - common):
                            found.append((min(p[i], last), max(p[i], last)))
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return placed.mapInArrow(compare, "a long, b long")


def _roots(links: DataFrame) -> DataFrame:
    return stored(star_roots(links.select(F.lit(0).alias("image"), "a", "b")).select(F.col("a").alias("rep"), F.col("b").alias("root")), "roots")


def _apart(own: np.ndarray, size: np.ndarray, root: np.ndarray, bits: tuple[np.ndarray, np.ndarray], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list (``own``) and different components whose sizes and bitmaps allow a link; with ``side``, of different sides
    where a list has two. Rows in order of size meet only those behind them that are small enough."""
    words, at = bits
    width = np.diff(np.append(at, len(words)))
    order = np.lexsort((size, own))
    _, number = np.unique(own, return_inverse=True)
    scale = int(size.max(initial=0)) * 100 // percent + 2
    place = (number * scale + size)[order]
    many = np.searchsorted(place, (number * scale + size * 100 // percent)[order], "right") - np.arange(len(order)) - 1
    two = np.zeros(len(own), bool) if side is None else (np.bincount(number, side != side[order][np.searchsorted(number[order], number)]) > 0)[number]
    ends, found, begin = np.cumsum(many), [], 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), "right")))
        n = many[begin:end]
        x = np.repeat(np.arange(begin, end), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        x, y, begin = order[x], order[y], end
        may = root[x] != root[y]
        if side is not None:
            may &= ~two[x] | (side[x] != side[y])
        x, y = x[may], y[may]
        for part in (range(2), range(2, WORDS), range(WORDS, 1 << 30)):
            same = width[x] == width[y]  # others are compared on full sets
            apart = np.zeros(len(x), np.int64)
            for w in range(min(part.stop, int(width[x].max(initial=0)))):
                here = same & (width[x] > w)
                here = slice(None) if here.all() else np.flatnonzero(here)
                apart[here] += np.bitwise_count(words[at[x[here]] + w] ^ words[at[y[here]] + w])
            near = ~same | (apart <= _allowed(size[x], size[y], percent))
            x, y = x[near], y[near]
        found.append(np.stack([x, y]))
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 2


def _bits(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All bitmaps' words in a row, and where each begins."""
    lists = group["bitmap"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()[:-1] - (lists.offsets[0].as_py() if len(lists) else 0)


def _scan(row: np.ndarray, gram: np.ndarray, rows: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common n-grams of the sets of rows ``x`` and ``y``: each row scans the inverted lists of its n-grams and counts whom it meets."""
    order = np.argsort(gram, kind="stable")
    lists, owner = gram[order], row[order]
    begin, end = np.searchsorted(lists, gram, "left"), np.searchsorted(lists, gram, "right")
    first = np.searchsorted(row, np.arange(rows + 1))
    by = np.argsort(x, kind="stable")
    common = np.zeros(len(x), np.int64)
    at = np.searchsorted(x[by], np.arange(rows + 1))
    for r in np.unique(x):
        b, e = begin[first[r]:first[r + 1]], end[first[r]:first[r + 1]]
        length = e - b
        places = np.repeat(b - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        here = by[at[r]:at[r + 1]]
        common[here] = np.bincount(owner[places], minlength=rows)[y[here]]
    return common


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of lists of over ``SHORT`` classes in pairs of tiles, ``low`` and ``high``, with their ``side``; a component that holds most of a list
    has tiles of its own, which are not paired with each other."""
    most = rows.groupBy("gram", "root", "m").agg(F.count("*").alias("k")).filter(F.col("k") * 2 > F.col("m")).select("gram", F.col("root").alias("giant"), "k")
    dealt = rows.join(most, "gram", "left").withColumn("own", F.coalesce(F.col("root") == F.col("giant"), F.lit(False)))
    rest = F.greatest(F.ceil((F.col("m") - F.coalesce("k", F.lit(0))) / TILE).cast("int"), F.lit(1))
    giants = F.ceil(F.col("k") / TILE).cast("int")
    tile = F.when(F.col("own"), -1 - F.pmod(F.xxhash64("rep"), giants)).otherwise(F.pmod(F.xxhash64("rep"), rest)).cast("int")
    behind = F.when(F.col("k").isNull() | F.col("own"), F.expr("cast(array() as array<int>)")).otherwise(F.sequence(-giants, F.lit(-1)))
    paired = dealt.withColumn("side", tile).withColumn("other", F.explode(F.concat(F.sequence(F.lit(0), rest - 1), behind)))
    return paired.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))


def _across(entries: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links between components that meet in a list, as few as join them.

    Short lists with the same least class, which near copies have in common, are scanned together. What has a partner by its bitmap is
    compared on full sets once per such bundle; a bundle with many of them goes list by list.
    """
    placed = entries.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lists = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.min("rep").alias("pivot"),
                                       F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    several = lists.filter("lo <> hi").groupBy("m", "who", "pivot").agg(F.min("gram").alias("gram")).select("gram", "m", "pivot")  # one of the lists with the same members
    rows = stored(placed.join(several, "gram").select("gram", "m", "pivot", "rep", "root"), "lists")
    short, none = rows.filter(F.col("m") <= SHORT), F.lit(0)
    bins = max(1, short.count() // BIN)
    together = short.select(F.pmod(F.xxhash64("pivot"), F.lit(bins)).alias("bin"), "pivot", F.col("gram").alias("own"), none.alias("side"), "rep", "root")
    tiles = _tiles(rows.filter(F.col("m") > SHORT)).withColumn("own", F.xxhash64("gram", "low", "high"))
    dealt = together.unionByName(tiles.select(F.col("own").alias("bin"), F.col("own").alias("pivot"), "own", "side", "rep", "root"))
    dealt = dealt.join(classes.select("rep", "size", "bitmap"), "rep")

    def partnered(group: pa.Table) -> pa.Table:
        pivot, own, side, root, size = (group[c].to_numpy() for c in ("pivot", "own", "side", "root", "size"))
        at = np.union1d(*_apart(own, size, root, _bits(group), percent, side))
        rep = group["rep"].to_numpy()[at]
        at, rep = at[np.argsort(rep, kind="stable")], np.sort(rep)
        pairs = np.unique(np.stack([pivot[at], rep]), axis=1)
        bundle, many = np.unique(pairs[0], return_counts=True)
        large = np.isin(pivot[at], bundle[many > 2 * TILE])
        unit = np.where(large, own[at], pivot[at])
        _, once = np.unique(np.stack([unit, rep]), axis=1, return_index=True)
        return group.select(["rep", "root"]).take(pa.array(at[once])).add_column(0, "unit", pa.array(unit[once]))

    def linked(group: pa.Table) -> pa.Table:
        _, once = np.unique(group["rep"].to_numpy(), return_index=True)  # a text may come from several tasks
        group = group.take(pa.array(once))
        root = group["root"].to_numpy()
        sets = [(a + doc, hashes) for a, _, doc, hashes in _sets(group, n)]
        row, gram = (np.concatenate(c) for c in zip(*sets, strict=True))
        size = np.bincount(row, minlength=len(root))
        width = widths(size)
        x, y = _apart(np.zeros(len(root), np.int64), size, root, (parities(row, gram, size), np.cumsum(width) - width), percent)
        common = _scan(row, gram, len(root), x, y)
        right = 100 * common >= percent * (size[x] + size[y] - common)
        joined, out = {}, []

        def top(i):
            while (up := joined.setdefault(i, i)) != i:
                joined[i] = i = joined[up]
            return i

        for a, b in np.unique(np.sort(np.stack([root[x[right]], root[y[right]]], 1), axis=1), axis=0).tolist():
            if (p := top(a)) != (q := top(b)):
                joined[max(p, q)] = min(p, q)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    some = stored(dealt.groupBy("bin").applyInArrow(partnered, "unit long, rep long, root long"), "partnered")
    members = some.groupBy("unit").agg(F.count("*").alias("m"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    units = members.groupBy("m", "least", "who").agg(F.min("unit").alias("unit")).select("unit")  # one of those with the same members
    wanted = stored(some.join(units, "unit").join(classes.select("rep", "key"), "rep").select("key", "unit", "rep", "root"), "wanted")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    if wanted.count() <= FEW:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
        texts = texts.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
    rows = texts.mapInArrow(_once, texts.schema).join(wanted, "key").select("unit", "rep", "root", "text")
    return rows.groupBy("unit").applyInArrow(linked, "a long, b long").distinct()


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, limit: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``; ``limit`` sets the boundary between small and large sets instead of the costs."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(named, n, percent), "signatures")
    own = signed.filter("size > 0")
    alike = [F.first(c).alias(c) for c in ("bitmap", "prefix", "hot", "small")]
    classes = stored(own.groupBy(F.col("d1").alias("rep"), "d2", "size").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), *alike), "classes")
    limit = boundary(classes, percent) if limit is None else min(limit, SMALL)
    small = stored(_small_links(classes, limit, percent), "links")
    # a small set is in lists only where a large one may be its partner
    entries = _met(classes.filter(F.col("size") >= least_partner(limit + 1, percent)), limit, percent)
    met = stored(entries, "entries")
    near = 100 * F.least("size", "p.size") >= percent * F.greatest("size", "p.size")  # a set shares no more than the smaller one has
    stars = met.filter((F.col("rep") != F.col("p.rep")) & near).select(F.col("p.rep").alias("p"), "rep").distinct()  # the smaller set, then the smaller rep, is p
    linked = small.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("rep")), F.struct(F.col("b").alias("p"), F.col("a").alias("rep")))).alias("l")).select("l.*")
    possible = stored(_possible(stars.join(linked, ["p", "rep"], "left_anti"), classes, percent), "possible")
    links = stored(small.unionByName(_confirmed(possible, named, classes, n, percent)), "links")
    roots = _roots(links)
    more = stored(_across(met.select("gram", "rep"), roots, classes, named, n, percent), "links")
    if not more.isEmpty():
        roots = _roots(links.unionByName(more))
    placed = classes.select("rep", "d2", "size", "doc_id").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(names, "root").select(F.col("rep").alias("d1"), "d2", "size", "component_id")
    return signed.select("doc_id", "size", "d1", "d2").join(found, ["d1", "d2", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
