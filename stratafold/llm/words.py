"""Words of many texts at once, as 64-bit hashes: whole-array passes over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from stratafold.llm.common import mixed

#: Bytes handled at once; a longer text is handled alone.
SLICE = 1 << 18


def slices(limits: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    n, a = len(limits) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(limits, limits[a] + size, "right")) - 1)
        yield a, b
        a = b


def _weights(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_hashes(data: np.ndarray, limits: np.ndarray, by_kind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each word ``[^\\x20\\x09-\\x0D]+`` in order; words never cross texts.

    ``by_kind`` also parts letters, digits and signs, so ``the!!`` is two words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = np.ones(n, np.int8)
    kind[(data == 32) | ((data >= 9) & (data <= 13))] = 0
    if by_kind:
        sign = (data >= 33) & (data < 128) & ~(((data | 32) >= 97) & ((data | 32) <= 122))
        kind[sign] = 2
        kind[(data >= 48) & (data <= 57)] = 3
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = kind[1:] != kind[:-1]
    inner = limits[:-1][(limits[:-1] < n)]
    begins[inner] = True
    begins &= kind > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number = np.cumsum(begins) - 1
    place = np.arange(n) - starts[np.maximum(number, 0)]
    place[: starts[0]] = 0
    worth = _weights(int(place.max()) + 1)[place] * (data.astype(np.uint64) + np.uint64(1))
    worth[kind == 0] = 0
    hashes = mixed(np.add.reduceat(worth, starts))
    return np.searchsorted(limits, starts, "right") - 1, hashes


def grams(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each run of ``n`` words; a text with fewer words gives its whole sequence as one."""
    if not len(words):
        return doc, words
    weight = _weights(n + 1)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    whole = len(words) - n + 1
    total = np.zeros(max(whole, 0), np.uint64)
    for i in range(n if whole > 0 else 0):
        total += words[i:i + whole] * weight[i]
    inside = doc[:whole] == doc[n - 1:] if whole > 0 else np.zeros(0, bool)
    docs, hashes = doc[:max(whole, 0)][inside], total[inside]
    short = np.flatnonzero(count < n)
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = count[short] > i
            sums[has] += words[first[short[has]] + i] * weight[i]
        docs = np.concatenate([docs, doc[first[short]]])
        hashes = np.concatenate([hashes, sums + count[short].astype(np.uint64) * weight[n]])
    return docs, mixed(hashes)


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, in order of text and hash."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]
