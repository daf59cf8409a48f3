"""Packing as vector bin packing: examples under limits on tokens, on segments and on tokens that bear loss.

Each task takes its examples in blocks of bounded size, wherever they lie, so nothing is shuffled. An example longer than a
sequence gives whole sequences; what remains is an item with a load in every dimension. A sequence takes, again and again, the
item that fits and has the largest dot product with what is left of each limit (both as shares of the limits, so a scarce
resource goes to items that use much of what is plentiful). When nothing fits and room remains, the largest item may be cut so
that its head fills the room (``cut_from`` tokens at least); the tail stays an item. At most one sequence per block stays open.

Nulls: a null text is empty and gives its end id only; null ids pass through. Repeated rows are packed once each. An empty table
gives no rows. Extra columns are ignored. Any length is cut as needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import one_by_one
from stratafold.llm.tokens import default_vocabulary, encoder

#: Items that compete for places at once; the figures of a block stay in a processor's cache.
BLOCK_ITEMS = 1024
#: Tokens of a block at most, but for its last example.
BLOCK_TOKENS = 4 << 20
#: Texts that are encoded at once.
TEXTS = 512


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; ``cut_from`` is the least head for which an item is cut, 0 for never."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    cut_from: int = 16


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """``(example, start, length, sequence, offset)`` of all pieces of one block.

    ``loss``: how many of an example's tokens, from its end, bear loss; an example's loss never exceeds its tokens.
    """
    pieces, sequence = [], 0
    head = min(limits.tokens, limits.loss_tokens)
    at = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero((tokens >= head) | (loss > limits.loss_tokens)):
        while (left := int(tokens[i] - at[i])) >= head:
            pieces.append((int(i), int(at[i]), head, sequence, 0))
            at[i] += head
            sequence += 1
            if left == head:
                break
    full = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    item = np.flatnonzero(at < tokens)  # the examples that wait, with their load in each dimension
    left = (tokens - at)[item]
    load = np.stack([left, np.ones_like(left), np.minimum(loss[item], left)]).astype(float)
    share = load / full[:, None]
    while len(item):
        room, offset = full.copy(), 0
        while len(item):
            fits = (load[0] <= room[0]) & (load[2] <= room[2]) & (room[1] >= 1)
            worth = np.where(fits, (room / full) @ share, -1.0)
            j = int(worth.argmax())
            if worth[j] >= 0:
                take = int(load[0, j])
            else:
                gap = int(min(room[0], room[2]))
                if not (limits.cut_from and gap >= limits.cut_from and room[1] >= 1):
                    break
                j = int(load[0].argmax())
                take = min(gap, int(load[0, j]))
            i, rest = int(item[j]), int(load[0, j]) - take
            pieces.append((i, int(at[i]), take, sequence, offset))
            room -= (take, 1, min(take, max(0, int(load[2, j]) - rest)))
            offset += take
            at[i] += take
            if rest:
                load[0, j], load[2, j] = rest, min(load[2, j], rest)
                share[:, j] = load[:, j] / full
            else:  # the last one takes its place
                item[j], load[:, j], share[:, j] = item[-1], load[:, -1], share[:, -1]
                item, load, share = item[:-1], load[:, :-1], share[:, :-1]
            if room[0] == 0:
                break
        sequence += 1
    return pieces


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None, end_id: int = 0, prompt_tokens: str | None = None, plain_specials: bool = False) -> DataFrame:
    """One row per piece: its ids as little-endian unsigned 32-bit numbers and its place.

    ``prompt_tokens`` names a column with the number of leading tokens that bear no loss; without it all do.
    ``padded_to``: the limit, or the sequence's own size where that is a power of two.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in PIECES.split(", "))])

    def task(batches):
        code, part, made = encoder(vocabulary, plain_specials), TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def block():
            nonlocal made
            tokens = np.array([len(ids) for _, ids, _ in held], np.int64)
            pieces = place(tokens, np.array([x for _, _, x in held], np.int64), limits)
            sums = np.bincount([s for *_, s, _ in pieces], [n for _, _, n, _, _ in pieces]).astype(np.int64)
            base = (part << 40) + made
            made += len(sums)
            for a in range(0, len(pieces), 1024):
                own = pieces[a:a + 1024]
                yield pa.record_batch([
                    pa.array([held[i][0] for i, *_ in own], pa.int64()), pa.array([s for _, s, *_ in own], pa.int64()), pa.array([n for _, _, n, _, _ in own], pa.int64()),
                    pa.array([held[i][1][s:s + n].astype("<u4").tobytes() for i, s, n, _, _ in own], pa.binary()), pa.array([tokens[i] for i, *_ in own], pa.int64()),
                    pa.array([base + q for *_, q, _ in own], pa.int64()), pa.array([o for *_, o in own], pa.int64()), pa.array([sums[q] for *_, q, _ in own], pa.int64()),
                    pa.array([int(sums[q]) if sums[q] & (sums[q] - 1) == 0 else limits.tokens for *_, q, _ in own], pa.int64()),
                ], schema=schema)

        for batch in (whole.slice(at, TEXTS) for whole in one_by_one(batches) for at in range(0, whole.num_rows, TEXTS)):
            for doc_id, prompt, ids in zip(batch["doc_id"].to_pylist(), batch["_prompt"].to_pylist(), code.encode(batch["text"].to_pylist()), strict=True):
                whole = np.append(np.frombuffer(ids, code.kind), np.array([end_id], code.kind))
                held.append((doc_id, whole, len(whole) - min(max(prompt or 0, 0), len(whole))))
                size += len(whole)
                if len(held) >= BLOCK_ITEMS or size >= BLOCK_TOKENS:
                    yield from block()
                    held, size = [], 0
        if held:
            yield from block()

    prompt = F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("_prompt"))
    return rows.mapInArrow(task, PIECES)
