"""Importance resampling towards a target text collection, with weights summed over bit planes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import spread, unused, words
from coverset.llm.pieces import by_bytes
from coverset.llm.sharding import numbered
from coverset.session import discard, materialise

# Features whose bucket a task remembers, and documents whose planes are held at a time.
MEMORY = 400_000
PLANE_ROWS = 64


class Buckets(dict):
    """Bucket of a feature, remembered; forgets everything when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[feature] = zlib.crc32(feature) % self.buckets
        return got


def features(text: str | None, longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    found = words(text)
    made = list(found)
    for k in range(2, longest + 1):
        made += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return made


def count(docs: DataFrame, buckets: int, longest: int, text_col: str) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and the counts of the buckets that occur, ascending."""
    place = docs.columns.index(text_col)
    keep = [f for f in docs.schema.fields if f.name != text_col]
    names = [unused(n, [f.name for f in keep]) for n in ("n_words", "n_features", "buckets", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for part in by_bytes(batches, place):
            n_words, totals, where, often = [], [], [], []
            for text in part.column(place).to_pylist():
                found = features(text, longest)
                n_words.append(len(words(text)) if longest > 1 else len(found))
                totals.append(len(found))
                b, c = np.unique(np.fromiter(map(known.__getitem__, found), np.int32, len(found)), return_counts=True)
                where.append(b)
                often.append(c.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in where])]).astype(np.int32))
            flat = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int32()) for x in (where, often)]
            others = [part.column(i) for i in range(part.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(n_words, pa.int64()), pa.array(totals, pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in flat)],
                names=[f.name for f in keep] + names,
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, f"{kinds}`{names[0]}` long, `{names[1]}` long, `{names[2]}` array<int>, `{names[3]}` array<int>")


def totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: every task adds up its own, so at most ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            where, often = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            held += np.bincount(where, weights=often, minlength=buckets).astype(np.int64)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["bucket", "n"])

    parts = counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
    held = np.zeros(buckets, np.int64)
    # One row a bucket, whatever the corpus.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[row.bucket] = row.n
    return held


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares, rounded down, for each bucket."""
    m, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000.0 * math.log(float(t + 1) * float(all_corpus + m) / (float(s + 1) * float(all_target + m)))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative whole numbers: ``[..., plane, word]`` of 64 buckets a word."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    width = -(-values.shape[-1] // 64) * 8
    out = np.zeros((*values.shape[:-1], bits, width), np.uint8)
    for k in range(bits):
        packed = np.packbits((values >> k & 1).astype(np.uint8), axis=-1, bitorder="little")
        out[..., k, : packed.shape[-1]] = packed
    return out.view(np.uint64)


def signed_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(signed power of two, plane)`` of gains: the planes of what is above zero, then of what is below."""
    made = []
    for sign, part in ((1, np.maximum(gain, 0)), (-1, np.maximum(-gain, 0))):
        made += [(sign << k, plane) for k, plane in enumerate(planes(part)) if plane.any()]
    return made


def weigh(counts: np.ndarray, signed: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain for each row: AND of planes, population counts, powers of two."""
    held = planes(counts)
    total = np.zeros(len(counts), np.int64)
    for j in range(held.shape[1]):
        mine = held[:, j]
        rows = np.flatnonzero(mine.any(axis=1))  # high planes are rarely set
        mine = mine[rows]
        for power, plane in signed:
            total[rows] += (power << j) * np.bitwise_count(mine & plane).sum(axis=1, dtype=np.int64)
    return total


def _weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counted`` without its counts, with ``weight``."""
    buckets = len(gain)
    signed = signed_planes(gain)
    names = [c for c in counted.columns if c not in ("buckets", "counts")]
    kinds = ", ".join(f"`{n}` {counted.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLANE_ROWS):
                part = batch.slice(at, PLANE_ROWS)
                where, often = part.column("buckets"), part.column("counts")
                row = np.repeat(np.arange(part.num_rows), where.value_lengths().to_numpy(zero_copy_only=False))
                dense = np.zeros((part.num_rows, buckets), np.int32)
                dense[row, where.flatten().to_numpy(zero_copy_only=False)] = often.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(weigh(dense, signed))], names=[*names, "weight"])

    return counted.select(*names, "buckets", "counts").mapInArrow(run, f"{kinds}, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    buckets: int = 10_000,
    longest: int = 1,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row for each row of ``docs``.

    A document's weight is the sum, over its features, of the gain of the
    feature's bucket: how much likelier the bucket is in ``target`` than in
    ``docs``. Its score adds Gumbel noise that depends on seed and id alone, so
    that the highest scores are a draw without replacement by weight. Of the
    rows with at least ``least_words`` words, ``percent`` in a hundred (rounded
    down) have a rank from 1; ties go to the smaller id, null ids first.

    The counts of both tables cover every word. Sums of gains are exact whole
    numbers. Texts are read once; their counts are kept as a table of a few
    bytes for each distinct bucket. A null or empty text has no features and
    weight 0. The noise of a null id is that of an empty one. Rows that repeat
    an id are one row each time and tie in their noise. An empty ``target``
    draws by rarity alone. Other columns are not read.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    counted = materialise(count(rows, buckets, longest, "text"))
    aim = count(spread(target.select(F.col(target_col).cast("string").alias("text"))), buckets, longest, "text")
    gain = gains(totals(counted, buckets), totals(aim, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    weighed = _weights(counted, gain).withColumn("score", (F.col("weight") + noise).cast("long"))
    weighed = materialise(weighed.select("doc_id", "n_words", "n_features", "weight", "score"))
    discard(counted)
    fit = weighed.filter(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    # Equal rows are dealt apart by a number of their own, so that no one id fills a task.
    order = fit.withColumns({"_low": -F.col("score"), "_own": F.monotonically_increasing_id()})
    placed = numbered(order, "_low", "doc_id", "n_features", "weight", "_own")
    rank = F.when(F.col("row_no") < drawn, F.col("row_no") + 1).cast("long")
    names = ["doc_id", "n_features", "weight", "score"]
    short = weighed.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return placed.select(*names, rank.alias("rank")).unionByName(short)
