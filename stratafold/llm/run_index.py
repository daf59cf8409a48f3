"""A run-length index of a text of many strings: its Burrows-Wheeler transform as runs, with text positions sampled at run ends.

Patterns are streamed through it from their last byte to their first, many side by side. A step inside the current run follows
the transform; else it jumps to the nearer run of the wanted byte, above or below, whose sampled position shares the longer
beginning with the current match, and the match is shortened to that. So each place of a pattern gets its matching statistic: the
length of its longest match, up to a cap, and a row of the index that begins with it.
"""

from __future__ import annotations

import numpy as np

#: Depths of the ranks that comparisons of two places go down; the first is packed into one number.
DEPTHS = (6, 12, 24, 48)


class RunIndex:
    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        ends = (np.cumsum(sizes + 1) - 1).astype(np.int32)  # fewer than two billion bytes
        self.text = data.astype(np.int16) + 1
        self.text[ends] = 0  # a separator, smaller than any byte
        n = len(self.text)
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
        self.end = ends[self.string]
        place = np.arange(n, dtype=np.int32)
        self.bits = np.uint64(max(1, (n - 1).bit_length()))  # of a place or a rank
        there = np.bincount(self.text, minlength=258) > 0
        code, width = (np.cumsum(there) - 1).astype(np.uint64)[self.text], np.uint64(max(1, int(there.sum() - 1).bit_length()))
        packed = np.zeros(n, np.uint64)
        for i in range(DEPTHS[0]):
            packed = (packed << width) | code[np.minimum(place + i, self.end)]
        self.ranks = []
        rank = self._ranked(packed)
        for depth in DEPTHS:
            self.ranks.append(rank)
            rank = self._deeper(rank, place, depth)
        while int(sizes.max(initial=0)) > 2 * depth:
            depth = 2 * depth
            rank = self._deeper(rank, place, depth)
        # equal strings to the end stay in the order of the text
        order = (np.sort((rank.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.order = order
        before = np.where(order > 0, self.text[order - 1], 0)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_first, self.run_byte = first, before[first]
        self.run_last = np.append(first[1:], n) - 1
        self.at_first, self.at_last = order[first], order[self.run_last]  # the sampled run ends
        length = self.run_last - first + 1
        counts = np.bincount(self.text, minlength=258)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        by_byte = np.argsort(self.run_byte, kind="stable")
        summed = np.cumsum(length[by_byte]) - length[by_byte]
        self.by_byte = by_byte
        self.byte_and_first = self._at(self.run_byte[by_byte], first[by_byte])  # ascending
        self.rank_before = np.zeros(len(first), np.int64)  # rows with the run's byte in earlier runs
        base = np.concatenate([[0], np.cumsum(np.bincount(self.run_byte, length, 258).astype(np.int64))])
        self.rank_before[by_byte] = summed - base[self.run_byte[by_byte]]

    def _ranked(self, keys: np.ndarray) -> np.ndarray:
        if int(keys.max(initial=0)) >> (64 - int(self.bits)):
            order = np.argsort(keys)
            sorted_keys = keys[order]
        else:  # place and key in one number: sorting values is several times faster than sorting places
            both = np.sort((keys << self.bits) | np.arange(len(keys), dtype=np.uint64))
            order, sorted_keys = both & ((np.uint64(1) << self.bits) - np.uint64(1)), both >> self.bits
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        return rank

    def _deeper(self, rank: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
        """Ranks by twice the depth."""
        return self._ranked((rank.astype(np.uint64) << self.bits) | rank[np.minimum(place + depth, self.end)].astype(np.uint64))

    def shared(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Bytes that the strings have in common from the text places ``a`` and ``b`` on, up to ``cap``."""
        size = np.zeros(len(a), np.int64)
        most = np.minimum(np.minimum(self.end[a] - a, self.end[b] - b), cap)
        for depth, rank in zip(DEPTHS[::-1], self.ranks[::-1], strict=True):
            for _ in range(max(1, -(-cap // depth) if depth == DEPTHS[-1] else 1)):
                x, y = np.minimum(a + size, self.end[a]), np.minimum(b + size, self.end[b])
                size += np.where((rank[x] == rank[y]) & (size < most), depth, 0)
        for _ in range(DEPTHS[0] - 1):
            x, y = np.minimum(a + size, self.end[a]), np.minimum(b + size, self.end[b])
            size += (self.text[x] == self.text[y]) & (size < most)
        return np.minimum(size, most)

    def statistics(self, patterns: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all patterns in a row: where each begins, and per byte the match's length, at most ``cap``, and its row."""
        sizes = np.array([len(p) for p in patterns], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int16) + 1
        lengths, rows = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        row, at, size = (np.zeros(len(patterns), np.int64) for _ in range(3))
        at += self.order[0]
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > step)
            place = starts[live] + sizes[live] - 1 - step
            byte = data[place]
            here = np.searchsorted(self.run_first, row[live], "right") - 1
            stays = self.run_byte[here] == byte
            self._follow(live[stays], here[stays], row, at, size, cap)
            if not stays.all():
                self._jump(live[~stays], byte[~stays], row, at, size, cap)
            lengths[place], rows[place] = size[live], row[live]
        return starts, lengths, rows

    def _at(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        return byte.astype(np.int64) * (len(self.text) + 1) + row

    def _jump(self, who, byte, row, at, size, cap) -> None:
        """To the nearest run of the byte, above or below, whose end shares more with the match; then one step from there."""
        below = np.searchsorted(self.byte_and_first, self._at(byte, row[who]))
        up, down = self.by_byte[np.maximum(below - 1, 0)], self.by_byte[np.minimum(below, len(self.by_byte) - 1)]
        has_up, has_down = (below > 0) & (self.run_byte[up] == byte), (below < len(self.by_byte)) & (self.run_byte[down] == byte)
        high = np.where(has_up, self.shared(at[who], self.at_last[up], cap), -1)
        low = np.where(has_down, self.shared(at[who], self.at_first[down], cap), -1)
        some = has_up | has_down
        lost = who[~some]
        row[lost], at[lost], size[lost] = 0, self.order[0], 0
        who, take, up, down = who[some], (high >= low)[some], up[some], down[some]
        size[who] = np.minimum(size[who], np.maximum(high, low)[some])
        row[who] = np.where(take, self.run_last[up], self.run_first[down])
        at[who] = np.where(take, self.at_last[up], self.at_first[down])
        self._follow(who, np.where(take, up, down), row, at, size, cap)

    def _follow(self, who, run, row, at, size, cap) -> None:
        """One step of the transform from rows that lie in the given runs."""
        row[who] = self.smaller[self.run_byte[run]] + self.rank_before[run] + row[who] - self.run_first[run]
        at[who] -= 1
        size[who] = np.minimum(size[who] + 1, cap)

    def intervals(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the ranges of rows that begin with the same ``size`` bytes, and whether the rows have so many at all.

        Comparisons at the largest depth that fits, the last one overlapping, cover any size; below the least depth, bytes do.
        """
        a, b = self.order[1:], self.order[:-1]
        depth, rank = max([(d, i) for i, d in enumerate(DEPTHS) if d <= size], default=(1, None))
        keys = self.text if rank is None else self.ranks[rank]
        same = np.ones(len(a), bool)
        for later in [*range(0, size - depth, depth), size - depth]:
            same &= keys[np.minimum(a + later, self.end[a])] == keys[np.minimum(b + later, self.end[b])]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        return first, (self.end[self.order] - self.order >= size)[first]
