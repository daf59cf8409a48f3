"""Near-duplicates by MinHash bands and odd sketches, with every link confirmed on the full shingle sets.

One pass over the texts makes, per document, the size and a 128-bit digest of its set of word shingles, ``BANDS`` keys of
``ROWS`` MinHash samples each, and an odd sketch: each sample turns one bit of a bitmap, so the population count of two sketches'
XOR tells how many samples differ. Documents with equal sets are one class, represented by its smallest id. Classes that share a
band key are candidates:

1. each class with the smallest class of its bucket (a star, so a bucket of m classes gives m - 1 pairs, not all);
2. once the links found so far are joined into components, the classes of a bucket that lie in different components, in tiles of
   bounded size. Pairs inside a component need no look, they cannot change the result, and the others stay inside their task.

A candidate goes on if its sizes and its sketches allow the similarity, and is then confirmed by intersecting the two full sets. A pair
at 0.8 shares no band key with a probability of 3 in a million; a pair at 0.8 is refused by its sketches beyond six standard
deviations. No bucket, partner or candidate is capped.

Nulls: a null text is empty; an empty text, or one without words, has no shingles and no links. A row without ``doc_id`` stands
alone and is kept. Rows with one id are one document. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import mixed, one_by_one, stored, utf8
from stratafold.llm.tokens import forget
from stratafold.llm.words import distinct, grams, lowered, slices, word_hashes
from stratafold.operators.components import star_roots

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
WORDS = 8  # of 64 bits, in a sketch
TILE = 1024


def shingle_sets(data: np.ndarray, limits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*grams(*word_hashes(lowered(data), limits), n))


def most_different(percent: int) -> int:
    """The XOR population count that sketches of sets at ``percent`` similarity exceed with negligible probability."""
    p = 1 - percent / 100
    samples = SAMPLES * p + 6 * math.sqrt(SAMPLES * p * (1 - p))
    bits = WORDS * 64
    return math.ceil(bits / 2 * (1 - math.exp(-2 * 2 * samples / bits))) + 6


def samples_of(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per text that has shingles: minima of ``SAMPLES`` permutations of 32-bit hashes."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    draws = mixed(np.arange(2 * SAMPLES, dtype=np.uint64) + np.uint64(977)).astype(np.uint32)
    out = np.empty((SAMPLES, len(first)), np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat((short ^ draws[2 * i]) * (draws[2 * i + 1] | np.uint32(1)), first)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    grouped = samples.astype(np.uint64).reshape(BANDS, ROWS, -1)
    weight = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed((grouped * weight[None, :, None]).sum(1, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(5))[:, None]).T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    sketch = np.zeros((samples.shape[1], WORDS), np.uint64)
    rows = np.arange(samples.shape[1])
    for i in range(SAMPLES):
        place = mixed(samples[i].astype(np.uint64) + np.uint64((i + 1) << 32)) % np.uint64(WORDS * 64)
        sketch[rows, (place >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (place & np.uint64(63))
    return sketch


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands, sketch``; the last two are empty without shingles."""
    def sign(batches):
        forget()
        for batch in one_by_one(batches):
            data, limits = utf8(batch["text"])
            for a, b in slices(limits):
                doc, hashes = shingle_sets(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a], n)
                size = np.bincount(doc, minlength=b - a)
                has = np.flatnonzero(size)
                digests, keys, sketches = np.zeros((2, b - a), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, WORDS), np.uint64)
                if len(has):
                    first = np.concatenate([[0], np.cumsum(size[has])[:-1]])
                    digests[0, has] = np.add.reduceat(hashes, first)
                    digests[1, has] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
                    samples = samples_of(doc, hashes)
                    keys, sketches = band_keys(samples), odd_sketches(samples)
                lists = []
                for values, width in ((keys, BANDS), (sketches, WORDS)):
                    limit = np.concatenate([[0], np.cumsum(np.where(size > 0, width, 0))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(limit), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64))))
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), *lists],
                                      names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, shingles`` of the documents with these ids."""
    def make(batches):
        forget()
        for batch in one_by_one(batches):
            data, limits = utf8(batch["text"])
            for a, b in slices(limits):
                doc, hashes = shingle_sets(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a], n)
                limit = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                yield pa.record_batch([batch["id"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(limit), pa.array(hashes.view(np.int64)))], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(make, "id long, shingles array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes and sketches allow the similarity, with ``z``, the sketches' difference."""
    facts = classes.select("rep", "n_shingles", "sketch")
    both = pairs.join(facts.toDF("a", "an", "asketch"), "a").join(facts.toDF("b", "bn", "bsketch"), "b")
    z = F.aggregate(F.zip_with("asketch", "bsketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.filter(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")).select("a", "b", z.alias("z")).filter(F.col("z") <= most_different(percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity on their full sets."""
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """``id, root`` of every linked class but the roots."""
    return star_roots(links.select(F.lit(0).alias("image"), "a", "b")).select(F.col("a").alias("id"), F.col("b").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    return rows.join(roots.toDF(column, name), column, "left").withColumn(name, F.coalesce(name, column))


def _different(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile pair, of different components, whose sizes and sketches allow the similarity."""
    rep, root, size, t = (group[c].to_numpy() for c in ("rep", "root", "n_shingles", "t"))
    sketch = group["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
    own = group["low"][0].as_py() == group["high"][0].as_py()
    found = []
    for at in range(0, len(rep), 256):
        rows = slice(at, at + 256)
        z = np.bitwise_count(sketch[rows, None, :] ^ sketch[None, :, :]).sum(2, dtype=np.int32)
        low, high = np.minimum(size[rows, None], size[None, :]), np.maximum(size[rows, None], size[None, :])
        right = (z <= most_different(percent)) & (100 * low >= percent * high) & (root[rows, None] != root[None, :]) & (rep[rows, None] < rep[None, :])
        if not own:
            right &= t[rows, None] != t[None, :]
        x, y = np.nonzero(right)
        found.append(np.stack([at + x, y]))
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 2


def _common(member: np.ndarray, shingle: np.ndarray, members: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``x`` and ``y``, from bitmaps over the shingles that several rows have."""
    _, number, count = np.unique(shingle, return_inverse=True, return_counts=True)
    several = count > 1
    column = (np.cumsum(several) - 1)[number]
    kept = several[number]
    member, column = member[kept], column[kept]
    total = np.zeros(len(x), np.int64)
    for first in range(0, int(several.sum()), 1 << 16):
        here = (column >= first) & (column < first + (1 << 16))
        bit = column[here] - first
        words = int(bit.max(initial=0)) // 64 + 1
        bits = np.zeros((members, words), np.uint64)
        np.bitwise_or.at(bits, (member[here], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        step = max(1, (1 << 20) // words)
        for at in range(0, len(x), step):
            total[at:at + step] += np.bitwise_count(bits[x[at:at + step]] & bits[y[at:at + step]]).sum(1, dtype=np.int64)
    return total


def _across(members: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between components that meet in a bucket, in tiles of about ``TILE`` classes.

    Pairs stay inside a task. The first pass over sketches gives the classes that have a possible partner in another component; the
    second has their full sets, and gives as few links between components as join what its confirmed pairs join.
    """
    placed = _rooted(members, roots, "rep", "root")
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select(
        "key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    rows = placed.join(split, "key").join(classes.select("rep", "n_shingles", "sketch"), "rep")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    rows = rows.withColumn("t", tile).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = ["key", "low", "high", "t", "rep", "root", "n_shingles", "sketch"]
    rows = rows.select("key", F.least("t", "u").alias("low"), F.greatest("t", "u").alias("high"), *columns[3:])

    def partnered(group: pa.Table) -> pa.Table:
        x, y = _different(group, percent)
        return group.select(columns).take(pa.array(np.union1d(x, y)))

    def confirmed(group: pa.Table) -> pa.Table:
        x, y = _different(group, percent)
        root, size = group["root"].to_numpy(), group["n_shingles"].to_numpy()
        lists = group["shingles"].combine_chunks()
        member = np.repeat(np.arange(group.num_rows), np.diff(lists.offsets.to_numpy()))
        common = _common(member, lists.flatten().to_numpy(zero_copy_only=False), group.num_rows, x, y)
        linked = 100 * common >= percent * (size[x] + size[y] - common)
        pairs = np.unique(np.sort(np.stack([root[x[linked]], root[y[linked]]], 1), axis=1), axis=0)
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[up]
            return i

        out = []
        for a, b in pairs.tolist():
            if (p := top(a)) != (q := top(b)):
                parent[max(p, q)] = min(p, q)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    kinds = "key long, low int, high int, t int, rep long, root long, n_shingles long, sketch array<long>"
    some = rows.groupBy("key", "low", "high").applyInArrow(partnered, kinds).join(sets.toDF("rep", "shingles"), "rep")
    return some.groupBy("key", "low", "high").applyInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document."""
    signed = stored(signatures(docs, n), "signatures")
    linkable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(linkable.groupBy("n_shingles", "d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot <> last").select("key", "pivot")
    members = stored(keys.join(buckets, "key"), "members")  # only of buckets with two classes or more
    stars = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    possible = stored(_possible(stars, classes, percent), "possible")
    sets = stored(_sets(docs, members.select(F.col("rep").alias("id")).distinct(), n), "sets")
    best = possible.groupBy("b").agg(F.min_by("a", F.struct("z", "a")).alias("a"))
    links = stored(_confirmed(best, sets, percent), "links")
    roots = stored(_roots(links), "roots")
    rest = _rooted(_rooted(possible, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").join(best, ["a", "b"], "left_anti")
    links = stored(links.unionByName(_confirmed(rest, sets, percent)), "links")
    roots = stored(_roots(links), "roots")
    more = stored(_across(members, roots, classes, sets, percent), "links")
    if not more.isEmpty():
        roots = stored(_roots(links.unionByName(more)), "roots")
    rep = classes.select("n_shingles", "d1", "d2", F.col("rep"))
    named = signed.join(rep, ["n_shingles", "d1", "d2"], "left").join(roots.toDF("rep", "root"), "rep", "left")
    component = F.coalesce("root", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
