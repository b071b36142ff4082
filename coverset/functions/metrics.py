"""Distance metrics by name.

Every metric offers a column expression for one pair of values and array code
for a pair of bounded blocks of rows. ``matrix`` may carry rounding noise up to
``slack``; ``exact`` gives the value of chosen pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return offsets - offsets[0], values


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def pack_sets(column) -> pa.Array:
    """Lists of ints as bytes: a bitmap after a 1 where that is shorter (ascending positions), else the ints after a 0."""
    offsets, values = _flat(column)
    values = values.astype("<i4", copy=False)
    sizes = np.diff(offsets).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    plain = np.ones(len(sizes), bool)
    if len(values):
        plain[rows[values < 0]] = False
        plain[rows[1:][(rows[1:] == rows[:-1]) & (values[1:] <= values[:-1])]] = False
    top = np.zeros(len(sizes), np.int64)
    top[sizes > 0] = values[offsets[1:][sizes > 0] - 1]
    as_bits = plain & (sizes > 0) & (top // 8 + 1 < 4 * sizes)
    lengths = np.where(as_bits, top // 8 + 1, 4 * sizes) + 1
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends[:-1]] = as_bits
    widths = np.where(as_bits, lengths - 1, 0)
    firsts = np.cumsum(widths) - widths
    marks = np.zeros(int(widths.sum()) * 8, np.uint8)
    mine = as_bits[rows]
    marks[firsts[rows[mine]] * 8 + values[mine]] = 1
    out[_spans(ends[:-1] + 1, widths)] = np.packbits(marks, bitorder="little")
    out[_spans(ends[:-1] + 1, np.where(as_bits, 0, lengths - 1))] = np.ascontiguousarray(values[~mine]).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def unpack_sets(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The lists that ``pack_sets`` made bytes of."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.binary())
    n = len(whole)
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8) if n and whole.buffers()[2] else np.zeros(0, np.uint8)
    lengths, as_bits = np.diff(ends) - 1, data[ends[:-1]] == 1
    widths = np.where(as_bits, lengths, 0)
    at = np.flatnonzero(np.unpackbits(data[_spans(ends[:-1] + 1, widths)], bitorder="little").view(bool))
    rows = np.repeat(np.arange(n), widths)[at >> 3]
    values = (at - 8 * (np.cumsum(widths) - widths)[rows]).astype(np.int32)
    if not as_bits.all():
        size = np.where(as_bits, 0, lengths)
        rows = np.concatenate([rows, np.repeat(np.arange(n), size // 4)])
        values = np.concatenate([values, data[_spans(ends[:-1] + 1, size)].view("<i4")])
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


class Euclidean:
    """Straight-line distance of two equally long ``array<double>`` values."""

    name = "euclidean"
    item_type = "array<double>"

    def column(self, a: Column, b: Column) -> Column:
        squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    def usable(self, item: Column) -> Column:
        return item.isNotNull() & F.forall(item, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def load(self, column) -> np.ndarray:
        offsets, values = _flat(column)
        rows = len(offsets) - 1
        if rows == 0:
            return np.zeros((0, 0))
        if not np.all(np.diff(offsets) == offsets[1]):
            raise ValueError("vectors of different length in one column")
        return values.reshape(rows, -1).astype(np.float64, copy=False)

    def slack(self, a: np.ndarray, b: np.ndarray) -> float:
        return 1e-6 * (1.0 + max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = (a * a).sum(1), (b * b).sum(1)
        square = np.maximum(na[:, None] + nb[None, :] - 2.0 * (a @ b.T), 0.0)
        # Cancellation spoils small distances only; redo those directly.
        i, j = np.nonzero(square < 1e-6 * (na[:, None] + nb[None, :]))
        for lo in range(0, len(i), 100_000):
            s, t = i[lo:lo + 100_000], j[lo:lo + 100_000]
            square[s, t] = ((a[s] - b[t]) ** 2).sum(1)
        return np.sqrt(square)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1.0 - self.matrix(a, b)

    def similarity_sums(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Summed similarity of each row of ``a`` to all of ``b``, and the other way round."""
        near = self.similarity(a, b)
        return near.sum(1), near.sum(0)

    def similarity_of(self, a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``similarity`` of chosen pairs."""
        return 1.0 - self.exact(a, b, i, j)

    def exact(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for lo in range(0, len(i), 100_000):
            s = slice(lo, lo + 100_000)
            out[s] = np.sqrt(((a[i[s]] - b[j[s]]) ** 2).sum(1))
        return out

    def close(self, a, b, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and distances of the pairs within ``cutoff``."""
        i, j = np.nonzero(self.matrix(a, b) <= cutoff + self.slack(a, b))
        d = self.exact(a, b, i, j)
        keep = d <= cutoff
        return i[keep], j[keep], d[keep]

    def take(self, block, rows):
        return block[rows]

    # A true metric of its own: used as is for pivot bounds.
    def bound_space(self, block):
        return block

    def bound_cutoff(self, cutoff: float) -> float:
        return cutoff

    bound = matrix


class Cosine(Euclidean):
    """``1 - cos`` of two vectors; a zero vector has distance 1 to everything."""

    name = "cosine"

    def column(self, a: Column, b: Column) -> Column:
        def dot(x: Column, y: Column) -> Column:
            return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms > 0, 1.0 - dot(a, b) / norms).otherwise(F.lit(1.0))

    def slack(self, a, b):
        return 1e-9

    @staticmethod
    def _unit(block: np.ndarray) -> np.ndarray:
        norm = np.sqrt((block * block).sum(1, keepdims=True))
        return np.divide(block, norm, out=np.zeros_like(block), where=norm > 0)

    def similarity(self, a, b):
        return self._unit(a) @ self._unit(b).T

    def matrix(self, a, b):
        return 1.0 - self.similarity(a, b)

    def exact(self, a, b, i, j):
        ua, ub = self._unit(a), self._unit(b)
        out = np.empty(len(i))
        for lo in range(0, len(i), 100_000):
            s = slice(lo, lo + 100_000)
            out[s] = 1.0 - (ua[i[s]] * ub[j[s]]).sum(1)
        return out

    # On unit vectors the chord length is a metric: chord^2 = 2 * (1 - cos).
    def bound_space(self, block):
        return self._unit(block)

    def bound_cutoff(self, cutoff):
        # A zero vector sits at distance 1 whatever its chord; no bound then.
        return math.sqrt(2.0 * max(cutoff, 0.0)) if cutoff < 1.0 else math.inf

    def bound(self, a, b):
        return Euclidean.matrix(self, a, b)


class BitSets:
    """A block of on-bit sets."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray):
        self.offsets, self.values = offsets, values
        self.sizes = np.diff(offsets).astype(np.int64)

    def __len__(self):
        return len(self.sizes)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def distinct(self) -> np.ndarray:
        """All bits in use, in order."""
        if not len(self.values) or self.values.min() < 0 or self.values.max() >= 1 << 20:
            return np.unique(self.values)
        used = np.zeros(int(self.values.max()) + 1, bool)
        used[self.values] = True
        return np.flatnonzero(used)

    def dense(self, universe: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self), len(universe)), dtype=np.float32)
        if len(universe) and len(self.values):
            at = np.minimum(np.searchsorted(universe, self.values), len(universe) - 1)
            known = universe[at] == self.values
            out[self.rows()[known], at[known]] = 1.0
        return out


class Bitmaps(BitSets):
    """A block of on-bit sets as rows of bits, the lowest first; positions are listed when asked for."""

    # Positions of a set at most, rows of a tile, and counts below it share a number of single precision by two.
    WIDTH, TILE, FIELD = 8192, 512, 1 << 12

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.sizes = _ones(bits)

    @classmethod
    def of(cls, block: BitSets) -> Bitmaps | None:
        """``block`` as bitmaps; none if they are too wide, or longer than the sets, or a position repeats."""
        if isinstance(block, Bitmaps):
            return block
        if not hasattr(block, "maps"):
            block.maps = cls._made(block)
        return block.maps

    @classmethod
    def _made(cls, block: BitSets) -> Bitmaps | None:
        values = block.values
        width = int(values.max(initial=0)) // 64 * 8 + 8
        if values.min(initial=0) < 0 or 8 * width > cls.WIDTH or len(block) * width > 16 * len(values) + (1 << 20):
            return None
        rows = block.rows()
        if ((rows[1:] == rows[:-1]) & (values[1:] <= values[:-1])).any():
            return None
        bits = np.zeros((len(block), width), np.uint8)
        for lo in range(0, len(block), 4096):
            here = slice(block.offsets[lo], block.offsets[min(lo + 4096, len(block))])
            marks = np.zeros((min(4096, len(block) - lo), 8 * width), np.uint8)
            marks[rows[here] - lo, values[here]] = 1
            bits[lo : lo + 4096] = np.packbits(marks, axis=1, bitorder="little")
        return cls(bits)

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    @cached_property
    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.bits, axis=1, bitorder="little"))
        return (at % max(8 * self.bits.shape[1], 1)).astype(np.int32)

    def marks(self, rows: slice, width: int) -> np.ndarray:
        """Zeros and ones of the first ``8 * width`` positions."""
        return np.unpackbits(self.bits[rows, :width], axis=1, bitorder="little").astype(np.float32)

    def shared(self, other: Bitmaps, wanted: Callable[[slice, slice], bool] | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Tiles of the wanted rows and columns with the positions that two sets share.

        Where counts are below ``FIELD``, a number holds the counts with two sets: their sum stays exact in single precision.
        """
        width = min(self.bits.shape[1], other.bits.shape[1])
        two = min(self.sizes.max(initial=0), other.sizes.max(initial=0)) < self.FIELD
        tall = [slice(lo, min(lo + self.TILE, len(self))) for lo in range(0, len(self), self.TILE)]
        opened = {}
        # One piece of memory for all tiles: a tile is used before the next one is made.
        product, whole, counts = np.empty(self.TILE**2, np.float32), np.empty(self.TILE**2, np.int32), np.empty(self.TILE**2, np.int32)
        for lo in range(0, len(other), self.TILE):
            wide = slice(lo, min(lo + self.TILE, len(other)))
            mine = [rows for rows in tall if wanted is None or wanted(rows, wide)]
            if not mine:
                continue
            y, n = other.marks(wide, width), wide.stop - wide.start
            half = (n + 1) // 2 if two else n
            if two:
                y[: n - half] += self.FIELD * y[half:]
            for rows in mine:
                if rows.start not in opened:
                    opened[rows.start] = self.marks(rows, width)
                x = opened[rows.start]
                made, both = whole[: len(x) * half].reshape(-1, half), counts[: len(x) * n].reshape(-1, n)
                np.copyto(made, np.matmul(x, y[:half].T, out=product[: len(x) * half].reshape(-1, half)), casting="unsafe")
                if two:
                    np.bitwise_and(made, self.FIELD - 1, out=both[:, :half])
                    np.right_shift(made[:, : n - half], self.FIELD.bit_length() - 1, out=both[:, half:])
                    made = both
                yield rows, wide, made


def _ones(bits: np.ndarray) -> np.ndarray:
    """Ones in each row of bytes."""
    whole = bits.shape[1] % 8 == 0 and bits.flags.c_contiguous
    return np.bitwise_count(bits.view(np.uint64) if whole else bits).sum(1, dtype=np.int64)


def align_sets(column) -> pa.Array | None:
    """What ``pack_sets`` made as bitmaps of one length; none where these are too long or the sets are not ascending."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.binary())
    n = len(whole)
    if not n:
        return None
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + n + 1].astype(np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)
    lengths, as_bits = np.diff(ends) - 1, data[ends[:-1]] == 1
    listed = lengths[~as_bits]
    values = data[_spans(ends[:-1][~as_bits] + 1, listed)].view("<i4")
    rows = np.repeat(np.flatnonzero(~as_bits), listed // 4)
    width = (max(int(lengths[as_bits].max(initial=0)), int(values.max(initial=0)) // 8 + 1) + 7) // 8 * 8
    if 8 * width > Bitmaps.WIDTH or n * width > 4 * len(data) + (1 << 20) or values.min(initial=0) < 0:
        return None
    if ((rows[1:] == rows[:-1]) & (values[1:] <= values[:-1])).any():
        return None
    out = np.zeros((n, width), np.uint8)
    size = lengths[as_bits]
    out.reshape(-1)[_spans(np.flatnonzero(as_bits) * width, size)] = data[_spans(ends[:-1][as_bits] + 1, size)]
    np.bitwise_or.at(out, (rows, values >> 3), np.left_shift(1, values & 7).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(out)])


def _bitmaps(column) -> Bitmaps:
    """The rows of ``align_sets``."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    width = whole.type.byte_width
    bits = np.frombuffer(whole.buffers()[1], np.uint8)[whole.offset * width : (whole.offset + len(whole)) * width]
    return Bitmaps(bits.reshape(-1, width))


class Tanimoto:
    """``1 - |a & b| / |a | b|`` of on-bit sets; two empty sets have distance 1."""

    name = "tanimoto"
    item_type = "array<int>"
    # Rows of a tile whose quotients are made at a time, so that they stay near the core.
    STEP = 64

    def column(self, a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        union = F.size(a) + F.size(b) - shared
        return F.when(union > 0, 1.0 - shared / union).otherwise(F.lit(1.0))

    def usable(self, item: Column) -> Column:
        return item.isNotNull()

    def load(self, column) -> BitSets:
        if pa.types.is_fixed_size_binary(column.type):
            return _bitmaps(column)
        return BitSets(*_flat(column))

    def slack(self, a, b):
        return 0.0

    def _counts(self, a: BitSets, b: BitSets) -> np.ndarray:
        x, y = Bitmaps.of(a), Bitmaps.of(b)
        if x is not None and y is not None:
            out = np.empty((len(a), len(b)), np.float32)
            for rows, columns, shared in x.shared(y):
                out[rows, columns] = shared
            return out
        universe = np.intersect1d(a.distinct(), b.distinct())
        if not len(universe):
            return np.zeros((len(a), len(b)), np.float32)
        # float32 counts are exact below 2^24 bits.
        return a.dense(universe) @ b.dense(universe).T

    def shared(self, a: BitSets, b: BitSets) -> np.ndarray:
        return self._counts(a, b).astype(np.float64)

    def similarity(self, a: BitSets, b: BitSets) -> np.ndarray:
        shared = self.shared(a, b)
        union = a.sizes[:, None] + b.sizes[None, :] - shared
        return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)

    def similarity_sums(self, a: BitSets, b: BitSets) -> tuple[np.ndarray, np.ndarray]:
        """Summed similarity of each row of ``a`` to all of ``b``, and the other way round."""
        x, y = Bitmaps.of(a), Bitmaps.of(b)
        if x is None or y is None:
            near = self.similarity(a, b)
            return near.sum(1), near.sum(0)
        mine, theirs = np.zeros(len(a)), np.zeros(len(b))
        # A union is not zero: where no position is in either set none is shared.
        left, right = x.sizes.astype(float)[:, None], np.maximum(y.sizes, 0.5)
        near, union = np.empty((self.STEP, x.TILE)), np.empty((self.STEP, x.TILE))
        for rows, columns, shared in x.shared(y):
            for lo in range(0, len(shared), self.STEP):
                here = slice(rows.start + lo, min(rows.start + lo + self.STEP, rows.stop))
                s, u = (held[: here.stop - here.start, : shared.shape[1]] for held in (near, union))
                np.copyto(s, shared[lo : lo + self.STEP])
                np.subtract(np.add(left[here], right[columns], out=u), s, out=u)
                np.divide(s, u, out=s)
                mine[here] += s @ np.ones(s.shape[1])
                theirs[columns] += np.ones(len(s)) @ s
        return mine, theirs

    def similarity_of(self, a: BitSets, b: BitSets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return 1.0 - self.exact(a, b, i, j)

    def matrix(self, a: BitSets, b: BitSets) -> np.ndarray:
        return 1.0 - self.similarity(a, b)

    def exact(self, a, b, i, j):
        x, y = Bitmaps.of(a), Bitmaps.of(b)
        if x is None or y is None:
            return self.matrix(a, b)[i, j]
        out, width = np.empty(len(i)), min(x.bits.shape[1], y.bits.shape[1])
        for lo in range(0, len(i), 20_000):
            s, t = i[lo : lo + 20_000], j[lo : lo + 20_000]
            common = _ones(x.bits[s, :width] & y.bits[t, :width])
            union = x.sizes[s] + y.sizes[t] - common
            out[lo : lo + 20_000] = 1.0 - np.divide(common, union, out=np.zeros(len(s)), where=union > 0)
        return out

    def least_shared(self, cutoff: float, most: int) -> np.ndarray:
        """Least number of common positions of a pair within the cutoff, for each sum of two sizes up to ``most``."""
        total = np.arange(most + 1)
        part = (1.0 - cutoff) / (2.0 - cutoff) if cutoff < 1.0 else 0.0
        some = np.maximum(np.floor(part * total).astype(np.int64)[:, None] + np.arange(-1, 3), 0)
        union = total[:, None] - some
        d = 1.0 - np.divide(some, union, out=np.zeros(union.shape), where=union > 0)
        return np.where((d <= cutoff).any(1), some[total, (d <= cutoff).argmax(1)], most + 1)

    def near(self, a: Bitmaps, b: Bitmaps, cutoff: float) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
        """Tiles that may hold pairs within ``cutoff``: rows, columns, which pairs are, and their common positions.

        Sizes alone settle tiles: no pair is more similar than the ratio of its sizes, and two sets share what
        exceeds the positions there are. All pairs of a tile that is settled so are within, and their common positions are not counted.
        """
        least = self.least_shared(cutoff, int(a.sizes.max(initial=0) + b.sizes.max(initial=0)))
        places = 8 * max(a.bits.shape[1], b.bits.shape[1])

        def wanted(rows: slice, columns: slice) -> bool:
            # The greatest number any pair shares is that of the smaller set; the quotient grows towards equal sizes.
            x, y = a.sizes[rows], b.sizes[columns]
            low, high = int(max(x.min(), y.min())), int(min(x.max(), y.max()))
            return high >= low or high >= least[high + low]

        def sure(rows: slice, columns: slice) -> bool:
            fewest = int(a.sizes[rows].min() + b.sizes[columns].min())
            return fewest - places >= 0 and bool((np.arange(fewest, len(least)) - places >= least[fewest:]).all())

        for rows in range(0, len(a), a.TILE):
            for columns in range(0, len(b), b.TILE):
                tile = slice(rows, min(rows + a.TILE, len(a))), slice(columns, min(columns + b.TILE, len(b)))
                if sure(*tile):
                    yield *tile, np.ones([t.stop - t.start for t in tile], bool), None
        for rows, columns, shared in a.shared(b, lambda r, c: wanted(r, c) and not sure(r, c)):
            sizes, at = np.unique(a.sizes[rows], return_inverse=True)
            yield rows, columns, shared >= least[sizes[:, None] + b.sizes[None, columns]].astype(np.int32)[at], shared

    def close(self, a: BitSets, b: BitSets, cutoff: float):
        x, y = Bitmaps.of(a), Bitmaps.of(b)
        if x is not None and y is not None:
            return self._close(x, y, cutoff)
        shared = self._counts(a, b)
        # A pair within the cutoff shares at least this part of both sizes; rounding is left to the exact test.
        part = (1.0 - cutoff) / (2.0 - cutoff) if cutoff < 1.0 else -1.0
        least = part * a.sizes, part * b.sizes
        slack = 1e-3 + 1e-6 * (a.sizes.max(initial=0) + b.sizes.max(initial=0))
        i, j = np.nonzero(shared >= (least[0] - slack).astype(np.float32)[:, None] + least[1].astype(np.float32)[None, :])
        common = shared[i, j].astype(np.float64)
        union = a.sizes[i] + b.sizes[j] - common
        d = 1.0 - np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        keep = d <= cutoff
        return i[keep], j[keep], d[keep]

    def _close(self, a: Bitmaps, b: Bitmaps, cutoff: float):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows, columns, mask, shared in self.near(a, b, cutoff):
            i, j = np.nonzero(mask)
            if not len(i):
                continue
            s, t = i + rows.start, j + columns.start
            if shared is None:
                d = self.exact(a, b, s, t)
            else:
                common = shared[i, j].astype(np.float64)
                union = a.sizes[s] + b.sizes[t] - common
                d = 1.0 - np.divide(common, union, out=np.zeros_like(common), where=union > 0)
            found.append((s, t, d))
        i, j, d = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(i * max(len(b), 1) + j)
        return i[order], j[order], d[order]

    def take(self, block: BitSets, rows: np.ndarray) -> BitSets:
        rows = np.asarray(rows)
        if rows.dtype == bool:
            rows = np.flatnonzero(rows)
        if isinstance(block, Bitmaps):
            return Bitmaps(block.bits[rows])
        sizes = block.sizes[rows]
        starts = block.offsets[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        return BitSets(offsets, block.values[np.repeat(starts, sizes) + inner])

    def bound_space(self, block):
        return block

    def bound_cutoff(self, cutoff):
        return cutoff

    bound = matrix


class SizedSets:
    """Sets to be searched for the nearest one: bitmaps in order of their size.

    Two sets are no more similar than the ratio of their sizes, so a row is
    compared only with tiles of sizes that can still hold its nearest set.
    Counts are products in single precision; quotients of counts up to twice
    ``MOST`` that differ do so in single precision too, so the greatest one is
    exact, and equal ones are equal there.
    """

    WIDTH, MOST = 8192, 1024
    ROWS, TILE = 512, 1024

    def __init__(self, parts: list[BitSets], ids: np.ndarray):
        sizes = np.concatenate([np.zeros(0, np.int64), *[p.sizes for p in parts]])
        order = np.argsort(sizes, kind="stable")
        self.sizes, self.ids = sizes[order], np.asarray(ids)[order]
        self.width = (max((int(p.values.max(initial=0)) for p in parts), default=0) // 8 + 1) * 8
        made = [np.packbits(self._marks(p), axis=1) for p in parts]
        self.bits = np.concatenate([np.zeros((0, self.width // 8), np.uint8), *made])[order]

    @classmethod
    def fits(cls, block: BitSets) -> bool:
        """Few enough positions for a bitmap, each once in a set."""
        if isinstance(block, Bitmaps):
            return 8 * block.bits.shape[1] <= cls.WIDTH
        if block.values.min(initial=0) < 0 or block.values.max(initial=0) >= cls.WIDTH:
            return False
        marks = block.rows() * cls.WIDTH + block.values
        return not (np.diff(marks) <= 0).any()

    def _marks(self, block: BitSets) -> np.ndarray:
        out = np.zeros((len(block), self.width), np.uint8)
        rows, known = block.rows(), block.values < self.width
        out[rows[known], block.values[known]] = 1
        return out

    def nearest(self, block: BitSets, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least distance and its id for each set of ``block``; ties to the lowest id.

        Distances beyond those ``known`` for the rows are not looked for; such a row's result is infinite.
        """
        similar, who = np.full(len(block), -1.0), np.full(len(block), np.iinfo(np.int64).max)
        order = np.argsort(block.sizes, kind="stable") if len(self.ids) else []
        for lo in range(0, len(order), self.ROWS):
            mine = order[lo : lo + self.ROWS]
            start = None if known is None else np.maximum(1.0 - known[mine] - 1e-9, -1.0)
            similar[mine], who[mine] = self._nearest(Tanimoto().take(block, mine), start)
        similar[who == np.iinfo(np.int64).max] = -1.0
        return np.where(similar < 0, np.inf, 1.0 - similar), who

    def _nearest(self, rows: BitSets, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        x, size = self._marks(rows).astype(np.float32), rows.sizes
        best, who = np.full(len(size), -1.0) if start is None else start, np.full(len(size), np.iinfo(np.int64).max)
        starts = np.arange(0, len(self.ids), self.TILE)
        least, most = self.sizes[starts], self.sizes[np.minimum(starts + self.TILE, len(self.ids)) - 1]
        # The greatest similarity that any row of these sizes has with a tile.
        bound = np.minimum(1.0, np.minimum(most / max(size[0], 1), size[-1] / np.maximum(least, 1)))
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best.min():
                break
            own = np.minimum(1.0, np.minimum(most[k] / np.maximum(size, 1), size / max(least[k], 1)))
            at = np.flatnonzero(best <= own)
            if not len(at):
                continue
            some = slice(starts[k], starts[k] + self.TILE)
            y = np.unpackbits(self.bits[some], axis=1).astype(np.float32)
            shared = (x if len(at) == len(x) else x[at]) @ y.T
            kind = np.float32 if max(size[-1], most[k]) <= self.MOST else np.float64
            union = np.maximum(size[at, None].astype(kind) + self.sizes[some].astype(kind) - shared, kind(1.0))
            near = np.divide(shared, union)
            j = near.argmax(1)
            i = np.arange(len(at))
            top = shared[i, j].astype(np.float64) / union[i, j]
            good = np.flatnonzero(top >= best[at])
            if not len(good):
                continue
            first = np.where(near[good] == near[good, j[good]][:, None], self.ids[some], np.iinfo(np.int64).max).min(1)
            rows_at, top = at[good], top[good]
            who[rows_at] = np.where(top > best[rows_at], first, np.minimum(first, who[rows_at]))
            best[rows_at] = top
        return best, who


METRICS = {m.name: m for m in (Tanimoto(), Euclidean(), Cosine())}


def metric_named(name: str):
    """The registered metric, or ``ValueError``."""
    if name not in METRICS:
        raise ValueError(f"unknown distance metric {name!r}; choose from {sorted(METRICS)}")
    return METRICS[name]


def as_items(df: DataFrame, id_col: str, item_col: str, metric: str) -> DataFrame:
    """Common shape of the pair operators: ``(id, item)`` without unusable rows."""
    m = metric_named(metric)
    item = F.col(item_col).cast(m.item_type)
    # A bit set holds each bit once, in order.
    item = F.array_sort(F.array_distinct(item)) if metric == "tanimoto" else item
    return (
        df.select(F.col(id_col).cast("long").alias("id"), item.alias("item"))
        .filter(F.col("id").isNotNull() & m.usable(F.col("item")))
    )


def register_sql_metrics(spark: SparkSession) -> None:
    """SQL functions ``tanimoto(a, b)``, ``euclid(a, b)`` and ``cosine_distance(a, b)``."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION tanimoto(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE
        RETURN CASE WHEN size(array_union(a, b)) > 0
                    THEN 1D - size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 1D END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION euclid(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN exists(a, x -> x != 0) AND exists(b, x -> x != 0)
                    THEN 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
                        / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))
                    ELSE 1D END"""
    )
