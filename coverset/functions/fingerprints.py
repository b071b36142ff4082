"""Hashed fingerprints of text or token arrays, and their storage forms."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Fixed defaults: neighbourhood radius 2, 1024 bits.
RADIUS, N_BITS = 2, 1024
# Rows and runs hashed at a time, and the longest run that fits one block of the hash.
ROWS, HASHED, ONE_BLOCK = 512, 8192, 55
# The hash's fixed values: additive constants, rotations and start.
SINES = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def token_array(df: DataFrame, column: str, pattern: str = TOKEN) -> Column:
    """Tokens of a text column by pattern; an array column is taken as is."""
    if dict(df.dtypes)[column].startswith("array"):
        return F.col(column).cast("array<string>")
    return F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))


def token_class(token: Column) -> Column:
    """Coarse class of a token: lower case, digits as ``#``."""
    return F.regexp_replace(F.lower(token), r"\d", "#")


def hashed_bit(gram: Column, n_bits: int) -> Column:
    """Bit of a token run: the first 32 bits of its MD5, modulo ``n_bits``."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(n_bits)).cast("int")


def hashed_fingerprint(
    df: DataFrame,
    column: str,
    radius: int = RADIUS,
    n_bits: int = N_BITS,
    pattern: str = TOKEN,
    use_features: bool = False,
    name: str = "fp",
) -> DataFrame:
    """Add the sorted on-bits (``array<int>``) of all token runs of 1 to ``radius + 1`` tokens.

    ``use_features`` hashes coarse token classes instead of the tokens.
    """
    tokens = token_array(df, column, pattern)
    if use_features:
        tokens = F.transform(tokens, token_class)

    return df.withColumn(name, _run_bits(tokens, radius, n_bits))


def md5_heads(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each slice of ``text``, all slices at once; long slices one by one."""
    out = np.empty(len(starts), np.int64)
    long = lengths > ONE_BLOCK
    for k in np.flatnonzero(long).tolist():
        part = text[starts[k] : starts[k] + lengths[k]].tobytes()
        out[k] = int.from_bytes(md5(part, usedforsecurity=False).digest()[:4], "big")
    short = ~long
    begin, size = starts[short], lengths[short]
    room = np.concatenate([text, np.zeros(64, np.uint8)]) if len(begin) and begin.max() + 64 > len(text) else text
    if len(begin):
        block = np.lib.stride_tricks.sliding_window_view(room, 64)[begin]
        block = np.where(np.arange(64) < size[:, None], block, np.uint8(0))
        block[np.arange(len(begin)), size] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = size * 8
        a, b, c, d = (np.full(len(begin), v, np.uint32) for v in START)
        for k in range(64):
            if k < 16:
                mixed, g = d ^ (b & (c ^ d)), k
            elif k < 32:
                mixed, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
            elif k < 48:
                mixed, g = b ^ c ^ d, (3 * k + 5) % 16
            else:
                mixed, g = c ^ (b | ~d), 7 * k % 16
            mixed += a
            mixed += words[g]
            mixed += SINES[k]
            turned = (mixed << np.uint32(TURNS[k])) | (mixed >> np.uint32(32 - TURNS[k]))
            a, d, c, b = d, c, b, b + turned
        out[short] = (a + np.uint32(START[0])).byteswap()
    return out


def _run_bits(tokens: Column, radius: int, n_bits: int) -> Column:
    """Sorted distinct ``hashed_bit`` of all runs; a run with a null token has none."""
    def run(column: pa.Array) -> pa.Array:
        parts = [some(column.slice(at, ROWS)) for at in range(0, len(column), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def some(column: pa.Array) -> pa.Array:
        flat = column.flatten().cast(pa.large_string())
        n = len(flat)
        bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1] if n else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        # All tokens of the batch, a space between every two: a run is a slice.
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        text = np.full(int(ends[-1]) + 1 if n else 0, 32, np.uint8)
        if n and bounds[-1] > bounds[0]:
            text[np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1] - starts, sizes)] = np.frombuffer(flat.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(column)), length)
        absent = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        found = []
        for k in range(min(radius + 1, n)):
            first = np.flatnonzero((row[k:] == row[: n - k]) & (absent[k + 1 :] == absent[: n - k]))
            for at in range(0, len(first), HASHED):
                here = first[at : at + HASHED]
                found.append(row[here] * n_bits + md5_heads(text, starts[here], ends[here + k] - starts[here]) % n_bits)
        if n_bits <= 1 << 16:
            seen = np.zeros(len(column) * n_bits, bool)
            for marks in found:
                seen[marks] = True
            marks = np.flatnonzero(seen)
        else:
            marks = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(marks // n_bits, minlength=len(column)))]).astype(np.int32)
        missing = column.is_null() if column.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((marks % n_bits).astype(np.int32)), mask=missing)

    return F.arrow_udf(run, "array<int>")(tokens)


def to_packed(bits: Column, n_bits: int = N_BITS) -> Column:
    """On-bits as ``array<bigint>``: bit ``b`` is bit ``b % 64`` of word ``b div 64``."""
    words = (n_bits + 63) // 64

    def run(column: pa.Array) -> pa.Array:
        flags = _flags(column, words * 64).reshape(-1, 8)
        flat = np.packbits(flags, axis=1, bitorder="little").reshape(-1).view("<i8")
        return _rows_of(flat, column, words, True)

    return F.arrow_udf(run, "array<bigint>")(bits)


def _flags(column: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` zeros and ones for each list; other positions and nulls are left out."""
    flat = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    fits = (values >= 0) & (values < width)
    out = np.zeros((len(column), width), np.uint8)
    out[rows[fits], values[fits]] = 1
    return out


def _rows_of(flat: np.ndarray, column: pa.Array, width: int, keep_null: bool) -> pa.Array:
    """Lists of ``width`` values; a null row stays null or becomes empty."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = flat.reshape(-1, width)[there].reshape(-1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(there * width)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(~there) if keep_null else None)


def packed_shared_bits(a: Column, b: Column) -> Column:
    """Number of bits set in both packed fingerprints."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n
    )


def to_dense(bits: Column, n_bits: int = N_BITS) -> Column:
    """On-bits as a 0/1 ``array<double>``; null becomes an empty array."""

    def run(column: pa.Array) -> pa.Array:
        return _rows_of(_flags(column, n_bits).astype(np.float64).reshape(-1), column, n_bits, False)

    return F.arrow_udf(run, "array<double>")(bits)


def to_vector(bits: Column, n_bits: int = N_BITS) -> Column:
    """On-bits as a Spark ML vector of ``n_bits`` values."""
    return array_to_vector(to_dense(bits, n_bits))
