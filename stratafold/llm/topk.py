"""Exact top-k by inner product without random access.

Every dimension of a block of vectors is a sorted list. A query with a positive weight reads it from the top, with a negative
weight from the bottom, all lists to the same depth. What has been read of a vector gives its lower bound (unread components
count as the list's worst value) and its upper bound (they count as the value at the reading depth). Reading deepens until few
vectors can still reach the k-th best lower bound; outsiders, seen or not, cannot qualify, and the scores of the rest are
resolved. Bounds for many queries at once are products of clipped matrices.

The query set is stated by the caller and meets all vectors in cells of a grid: a cell holds a lane of the vectors and a group of the
queries, both of bounded size, and reads each of its blocks once. Vectors are copied once per group, queries once per lane, by a
shuffle and never by a broadcast. A cell keeps each query's k best so far; the k-th is the bar of its next block, and reading begins at
the depth that resolved the block before. A cell returns k rows per query, and Spark's ranked windows cut them to k before and after the
shuffle.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids. Only vectors of a query's own
length are compared. Rows that share an id with the query are its own and no candidates. Ties go to the smaller id. Repeated rows
count each. Scores must fit in 64 bits. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, queries in a block.
BLOCK, QUERY_BLOCK = 2048, 256
#: Parts of the lists that are read at first; then twice as much each time.
FIRST_DEPTH = 8
#: Resolve when the queries have no more than so many times k vectors left on average.
RESOLVE = 4
#: Numbers in a lane of vectors or a group of queries at most, and in a lane at least.
LANE, LEAST_LANE = 1 << 23, 1 << 19
_BLOCKS = "d int, ids binary, values binary"


def _narrow(values: np.ndarray) -> np.ndarray:
    """The numbers in the smallest of three types that holds them all."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _read(d: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and its matrix; the type follows from the length."""
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(values, f"i{len(values) // (len(ids) * d)}").reshape(-1, d)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``id, vector`` of integers gathered, where they lie, into matrices of ``size`` rows and equal length."""
    schema = pa.schema([("d", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])

    def gather(batches):
        held: dict[int, list] = {}

        def out(d):
            ids, values = zip(*held.pop(d), strict=True)
            return pa.record_batch([pa.array([d], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                                    pa.array([_narrow(np.stack(values)).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            lists = batch["vector"]
            flat, limits = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, vec_id in enumerate(batch["id"].to_pylist()):
                vector = flat[limits[i]:limits[i + 1]].astype(np.int64)
                d = len(vector)
                held.setdefault(d, []).append((vec_id, vector))
                if len(held[d]) >= size:
                    yield out(d)
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(gather, _BLOCKS)


def _most(values: np.ndarray) -> float:
    return max(-float(values.min(initial=0)), float(values.max(initial=0)))


def best_of_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None,
                  first: int | None = None, made: dict | None = None):
    """``(query index, vector index, score)`` arrays: for each query the block's candidates that can be among its k best.

    ``bars``: a score per query that k others have reached, where known; ``first``: the depth to begin with. ``made`` keeps, by type, the
    block's numbers and lists from one call to the next, and under ``depth`` the depth that was enough.
    """
    n, d = vectors.shape
    made = {} if made is None else made
    if "most" not in made:
        made["most"] = _most(vectors)
    bound = made["most"] * _most(queries) * d
    kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64  # sums are exact in each
    if kind not in made:
        made[kind] = (x := vectors.astype(kind)), np.sort(x, axis=0)
    x, lists = made[kind]
    q = queries.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    depth = min(n, max(1, -(-n // FIRST_DEPTH) if first is None else first))
    alive = np.arange(n)
    while True:
        seen = x if len(alive) == n else x[alive]
        top, bottom = lists[n - depth], lists[depth - 1]
        if depth == n:
            upper = lower = q @ seen.T
        else:
            upper = up @ np.maximum(seen, top).T + down @ np.minimum(seen, bottom).T
        if bars is None:
            own = query_ids[:, None] == ids[None, alive]
            if depth < n:
                lower = up @ np.where(seen >= top, seen, lists[0]).T + down @ np.where(seen <= bottom, seen, lists[-1]).T
            least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            lower = np.where(own, least, lower)
            at = len(alive) - k
            bar = np.partition(lower, at, axis=1)[:, at, None] if at > 0 else np.full((len(q), 1), least)
        else:
            bar = bars[:, None]
        left = upper >= bar
        if depth == n or np.count_nonzero(left) <= RESOLVE * k * len(q):
            break
        alive = alive[left.any(0)]
        depth = min(n, 2 * depth)
    made["depth"] = depth
    rows, columns = np.nonzero(left)
    others = query_ids[rows] != ids[alive[columns]]
    rows, columns = rows[others], columns[others]
    scores = upper[rows, columns] if depth == n else np.einsum("ij,ij->i", q[rows], x[alive[columns]])
    return rows, alive[columns], scores.astype(np.int64)


def _firsts(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query, by query, score and id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def search(lane: pa.Table, group: pa.Table) -> pa.Table:
        asked = [_read(*r) for r in zip(*(group[c].to_pylist() for c in ("d", "ids", "values")), strict=True)]
        best = [(np.zeros(0, np.int64),) * 3 for _ in asked]
        depths: list[float | None] = [None] * len(asked)
        for d, ids, values in zip(lane["d"], lane["ids"], lane["values"], strict=True):
            ids, vectors = _read(d.as_py(), ids.as_py(), values.as_py())
            made: dict = {}
            for i, (query_ids, queries) in enumerate(asked):
                held, full = best[i], None
                if len(held[0]) == k * len(queries):  # each query has k, so the k-th is a bar
                    full = held[2].reshape(-1, k)[:, -1]
                first = None if depths[i] is None else int(np.ceil(depths[i] * len(ids)))
                found = best_of_block(ids, vectors, query_ids, queries, k, full, first, made)
                if full is not None:
                    depths[i] = made["depth"] / len(ids)
                if len(found[0]):
                    merged = zip(held, (found[0], ids[found[1]], found[2]), strict=True)
                    best[i] = _firsts(*(np.concatenate(x) for x in merged), k)
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (
            [query_ids[b[0]] for (query_ids, _), b in zip(asked, best, strict=True)], [b[1] for b in best], [b[2] for b in best])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


def _grid(clean: DataFrame, partitions: int) -> tuple[int, int, int]:
    """Lanes of vectors, groups of queries and blocks of queries, by one pass over the sizes.

    There are more lanes than their size asks for while the shuffle has partitions for them and the queries' copies are no more than the vectors.
    """
    size, asked = F.size("vector").cast("long"), F.col("is_query")
    r = clean.agg(F.sum(size).alias("all"), F.sum(F.when(asked, size)).alias("asked"), F.count_if(asked).alias("queries")).first()
    whole, some = r["all"] or 1, r["asked"] or 1
    lanes = max(-(-whole // LANE), min(partitions, -(-whole // LEAST_LANE), -(-whole // some)))
    return lanes, -(-some // LANE), max(1, -(-r["queries"] // QUERY_BLOCK))


def top_k(rows: DataFrame, vec_id: str, vector: Column, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds against all rows; ``vector``: array of longs."""
    clean = rows.select(F.col(vec_id).cast("long").alias("id"), vector.alias("vector"), is_query.alias("is_query")).filter(
        "id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, v -> v IS NULL)")
    lanes, groups, blocks = _grid(clean, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    queries = _blocks(clean.filter("is_query").select("id", "vector").repartition(blocks, "id"), QUERY_BLOCK)
    vectors = _blocks(clean.select("id", "vector"), BLOCK)

    def dealt(parts: int) -> Column:
        """Blocks in turn, each task beginning one further; the task's number is in the upper bits."""
        place = F.monotonically_increasing_id()
        return F.pmod(F.shiftright(place, 33) + place.bitwiseAND((1 << 33) - 1), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    vectors = vectors.withColumn("lane", dealt(lanes)).withColumn("part", every(groups))
    asking = queries.withColumn("part", dealt(groups)).withColumn("lane", every(lanes))
    cell = ["d", "lane", "part"]
    found = vectors.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
