"""Small NumPy helpers that run inside tasks, one section or tile at a time. They travel by value, so executors need no install."""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def path_through(pdf: pd.DataFrame, slope: int) -> pd.DataFrame:
    """The highest-scoring path through one section's score grid, moving at most ``slope`` steps per ray.

    By definition: the best sum that ends in a cell is the cell's own score plus the best sum among the ``2 * slope + 1`` cells
    around it on the ray before; of equal sums the outermost counts. Unusable cells have no sum. Where no cell around has one,
    the path begins anew and stays on its step. ``total`` is the largest sum on the last ray.
    """
    own = pdf[pdf["usable"].astype(bool)].pivot(index="ray", columns="step", values="score").reindex(
        index=range(int(pdf["ray"].max()) + 1), columns=range(int(pdf["step"].max()) + 1)).fillna(-np.inf).to_numpy("float64")
    ends, moves = own[0], []
    for scores in own[1:]:
        around = np.lib.stride_tricks.sliding_window_view(np.pad(ends, slope, constant_values=-np.inf), 2 * slope + 1)
        best = around.max(axis=1)
        outermost = 2 * slope - np.argmax(around[:, ::-1] == best[:, None], axis=1)
        anew = np.isneginf(best)
        moves.append(np.where(anew, 0, outermost - slope))
        ends = np.where(anew, 0.0, best) + scores
    walk = itertools.accumulate(reversed(moves), lambda step, move: step + int(move[step]), initial=int(np.argmax(ends)))
    return pd.DataFrame({"image": pdf["image"].iloc[0], "ray": np.arange(len(own)), "step": list(walk)[::-1], "total": float(ends.max())})


def filled_pixels(lists: pd.Series, height: int, width: int) -> pd.Series:
    """Whole pixels inside each closed polygon, given as a flat list ``y1, x1, y2, x2, ..`` of its edges, by the even-odd rule.

    An edge crosses row ``y`` when exactly one end is at or above it; read from the right, crossings are added and taken off in turn.
    Polygons are taken in portions of a bounded number of crossings.
    """
    portion = np.cumsum(lists.map(len).to_numpy("int64") // 4 * height) >> 20
    return pd.concat([_filled_portion(some, height, width) for _, some in lists.groupby(portion)]) if len(lists) else pd.Series([], dtype="int64")


def _filled_portion(lists: pd.Series, height: int, width: int) -> pd.Series:
    sizes = lists.map(len).to_numpy("int64") // 4
    y1, x1, y2, x2 = (np.concatenate([np.asarray(v, "int64") for v in lists]).reshape(-1, 4).T if sizes.sum() else np.zeros((4, 0), "int64"))
    low, high = np.maximum(np.minimum(y1, y2), 0), np.minimum(np.maximum(y1, y2), height)
    rows = np.maximum(high - low, 0)
    edge = np.repeat(np.arange(len(rows)), rows)
    y = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows) + low[edge]
    at = x1[edge] + (y - y1[edge]) * (x2 - x1)[edge] / (y2 - y1)[edge].astype("float64")
    c = np.clip(np.ceil(at), 0, width).astype("int64")
    ring = np.repeat(np.arange(len(sizes)), sizes)[edge]
    code = np.sort((ring * height + y) * (width + 1) + width - c)  # rows one after another, each from the right
    line = code // (width + 1)
    opens = np.flatnonzero(np.r_[True, np.diff(line) != 0][:len(line)])
    place = np.arange(len(code)) - np.repeat(opens, np.diff(np.r_[opens, len(code)]))
    signed = np.where(place % 2 == 0, 1, -1) * (width - code % (width + 1))
    return pd.Series(np.bincount(line // height, signed, len(sizes)).astype("int64"), lists.index)


def ring_masks(batch: pa.RecordBatch, keys: list[str], height: int, width: int, words: int):
    """Bitmaps of the rows of closed polygons, one polygon a row with its vertices ``ring`` in order: batches ``keys, y, tile, inside``.

    A crossing sets the last pixel that it turns; the exclusive or of all bits to the right then says what is inside. Polygons are taken
    in portions of a bounded number of crossings and of words.
    """
    tiles = -(-width // (64 * words))
    rings = batch.column("ring")
    sizes = np.asarray(rings.value_lengths().to_numpy(zero_copy_only=False), "int64")
    whole = all(pa.types.is_integer(rings.type.value_type.field(c).type) for c in ("y", "x"))
    portion = np.cumsum((sizes + tiles) * height) >> 19
    for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(portion)) + 1):
        flat = rings.slice(some[0], len(some)).flatten() if len(some) else None
        if flat is None or not len(flat):
            continue
        n = sizes[some]
        known = np.logical_and(*[flat.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("y", "x")])
        ys, xs = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype("int64" if whole else "float64") for c in ("y", "x"))
        after = np.arange(len(ys)) + 1
        after[np.cumsum(n)[n > 0] - 1] = (np.cumsum(n) - n)[n > 0]
        kept = known & known[after] & (ys != ys[after])
        ring, y1, x1, y2, x2 = np.repeat(np.arange(len(n)), n)[kept], ys[kept], xs[kept], ys[after][kept], xs[after][kept]
        low = np.maximum(np.ceil(np.minimum(y1, y2)), 0).astype("int64")
        rows = np.maximum(np.minimum(np.ceil(np.maximum(y1, y2)), height).astype("int64") - low, 0)
        edge = np.repeat(np.arange(len(rows)), rows)
        y = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows) + low[edge]
        at = x1[edge] + (y - y1[edge]) * (x2 - x1)[edge] / (y2 - y1)[edge].astype("float64")
        bit = np.clip(np.ceil(at), 0, width).astype("int64") - 1
        line, bit = (ring[edge] * height + y)[bit >= 0], bit[bit >= 0]
        turned = np.zeros(len(n) * height * tiles * words, "uint64")
        np.bitwise_xor.at(turned, line * tiles * words + (bit >> 6), np.uint64(1) << (bit & 63).astype("uint64"))
        for step in (1, 2, 4, 8, 16, 32):
            turned ^= turned >> np.uint64(step)
        turned = turned.reshape(-1, tiles * words)
        odd = np.bitwise_xor.accumulate(turned[:, ::-1] & np.uint64(1), axis=1)[:, ::-1]  # words from each on
        turned[:, :-1] ^= np.uint64(0) - odd[:, 1:]
        turned = turned.reshape(-1, words)
        found = np.flatnonzero(turned.any(axis=1))
        inside = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype="int32") * words), pa.array(turned[found].view("int64").ravel()))
        owner = pa.array(some[0] + found // (height * tiles))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k).take(owner) for k in keys], pa.array(found // tiles % height), pa.array((found % tiles).astype("int32")), inside], [*keys, "y", "tile", "inside"])


def column_distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """Second pass of the exact distance transform for a band of columns: min over rows of row distance squared plus dy squared."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    far = 2 ** 40
    grid = np.full((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), far, dtype="int64")
    ys, xs = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
    grid[ys, xs] = pdf["g2"].fillna(far).to_numpy("int64")
    best = grid.copy()
    for d in range(1, len(grid)):
        if d * d >= best.max():
            break
        np.minimum(best[d:], grid[:-d] + d * d, out=best[d:])
        np.minimum(best[:-d], grid[d:] + d * d, out=best[:-d])
    return pd.DataFrame({"image": pdf["image"], "y": pdf["y"], "x": pdf["x"], "d2": best[ys, xs]})


def tile_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected pieces inside one tile, each named by its first pixel in raster order; rows are joined run by run."""
    pdf = pdf.sort_values(["y", "x"]).reset_index(drop=True)
    y, x = pdf["y"].to_numpy("int64"), pdf["x"].to_numpy("int64")
    code = (y << 20) | x
    opens = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)]
    run = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = np.r_[first[1:] - 1, len(x) - 1]
    row, lo, hi = y[first], x[first], x[last]
    parent = np.arange(len(first))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.searchsorted(row, np.unique(row))
    bounds = dict(zip(np.unique(row).tolist(), zip(starts.tolist(), np.r_[starts[1:], len(row)].tolist())))
    for level, (a, b) in bounds.items():
        if level - 1 not in bounds:
            continue
        p, q = bounds[level - 1]
        left = p + np.searchsorted(hi[p:q], lo[a:b])
        right = p + np.searchsorted(lo[p:q], hi[a:b], side="right")
        for i in range(a, b):
            for j in range(left[i - a], right[i - a]):
                u, v = root(i), root(j)
                if u != v:
                    parent[max(u, v)] = min(u, v)
    names = code[first]
    roots = np.array([root(i) for i in range(len(first))], dtype=int)
    return pd.DataFrame({"image": pdf["image"], "y": y, "x": x, "local": names[roots[run]]})


def annulus_means(pdf: pd.DataFrame, tile: int, halo: int, zones: tuple) -> pd.DataFrame:
    """Means over annuli around the pixels of one tile; pixels that are not there count as zero, as beyond the image's edge."""
    ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
    y0, x0, side = ty * tile - halo, tx * tile - halo, tile + 2 * halo
    grid = np.zeros((side, side))
    grid[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["value"].to_numpy()
    size = 2 * side
    spectrum = np.fft.rfft2(grid, (size, size))
    own = pdf[(pdf["y"] // tile == ty) & (pdf["x"] // tile == tx)]
    oy, ox = own["y"].to_numpy() - y0, own["x"].to_numpy() - x0
    out = {"image": own["image"], "y": own["y"], "x": own["x"]}
    for name, inner, outer in zones:
        reach = int(np.ceil(outer))
        dy, dx = np.mgrid[-reach:reach + 1, -reach:reach + 1]
        ring = ((np.hypot(dy, dx) >= inner) & (np.hypot(dy, dx) <= outer)).astype(float)
        made = np.fft.irfft2(spectrum * np.fft.rfft2(ring / ring.sum(), (size, size)), (size, size))
        out[name] = made[oy + reach, ox + reach]
    return pd.DataFrame(out)


def hull_corners(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corners of the upper hull of one border, in one pass over its rays; points on a chord are not corners."""
    pdf = pdf.sort_values("ray")
    rays, values = pdf["ray"].to_numpy("int64"), pdf["v"].to_numpy("float64")
    kept: list[int] = []
    for i in range(len(rays)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            rise = (values[b] - values[a]) * (rays[i] - rays[b]) - (values[i] - values[b]) * (rays[b] - rays[a])
            if rise > 0:
                break
            kept.pop()
        kept.append(i)
    return pd.DataFrame({"image": pdf["image"].iloc[kept], "ray": rays[kept], "corner": True})
