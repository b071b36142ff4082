"""Benchmark decontamination by a broadcast set of hashed test n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import spread, slices, unused, words
from coverset.session import materialise

# Benchmark text held in one broadcast set; more is scanned in further passes. A worker's set takes about ten bytes for each.
SET_BYTES = 16 * 1024 * 1024
NO_ITEMS = hashlib.sha256(b"").hexdigest()


class Windows:
    """Normalised windows of some benchmark items as sorted 64-bit hashes, verified by their words.

    Words are numbers of a vocabulary; the items' words are one flat array. A
    window costs 8 bytes for its hash and 12 for its place and item, so the set
    takes a few bytes for each byte of benchmark text, whatever the overlap.
    """

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        known, flat, starts = self.vocabulary, [], [0]
        self.names = [str(item) for item, _ in items]
        for _, text in items:
            flat.append(np.fromiter((known.setdefault(w, len(known) + 1) for w in words(text)), np.int32))
            starts.append(starts[-1] + len(flat[-1]))
        self.flat = np.concatenate([np.empty(0, np.int32), *flat])
        lengths = np.diff(starts)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(size, n) for n in lengths.tolist() if n}):
            held = np.flatnonzero(np.minimum(lengths, size) == width)
            counts = lengths[held] - width + 1
            place = np.repeat(np.array(starts)[held], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = self._hash(self.flat, place, width)
            order = np.argsort(hashes, kind="stable")
            self.by_size[width] = (hashes[order], place[order], np.repeat(held, counts)[order].astype(np.int32))

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """A hash of the ``width`` numbers that begin at each place (wrapping 64-bit arithmetic)."""
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = (out ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _hits(self, ids: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places where a window of ``width`` words begins, and its item, once for every item that has it."""
        hashes, place, item = self.by_size[width]
        wanted = self._hash(ids, at, width)
        lo, hi = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        met = np.flatnonzero(hi > lo)
        n = (hi - lo)[met]
        where = np.repeat(at[met], n)
        row = np.repeat(lo[met], n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
        same = np.ones(len(where), bool)
        for k in range(width):
            same &= ids[where + k] == self.flat[place[row] + k]
        return where[same], item[row[same]]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each text its number of words, merged spans ``(first, last + 1)`` of hit words and the items found."""
        get, many = self.vocabulary.get, [words(t) for t in texts]
        # One array for all texts, an unknown word between them: no window goes over it.
        ids = np.fromiter((i for found in many for i in (*[get(w, 0) for w in found], 0)), np.int32)
        ends = np.cumsum([len(found) + 1 for found in many])
        starts = ends - [len(found) + 1 for found in many]
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        out: list[tuple[int, list, set]] = [(len(found), [], set()) for found in many]
        for width in self.by_size:
            at = np.flatnonzero(known[width:] - known[: max(len(known) - width, 0)] == width)
            where, item = self._hits(ids, at, width)
            text = np.searchsorted(ends, where, "right")
            for t, k, i in zip(text.tolist(), (where - starts[text]).tolist(), item.tolist()):
                out[t][1].append((k, k + width))
                out[t][2].add(self.names[i])
        return [(n, _united(spans), items) for n, spans, items in out]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def _passes(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of at most about ``limit`` bytes of text."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("item IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [rows.filter(part == k) for k in range(count)]


def _scanner(windows, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Windows(windows.value, size)
        for part in slices(batches):
            seen = held.scan(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for n, _, _ in seen], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in s] for _, s, _ in seen], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array([sorted(i) for _, _, i in seen], pa.list_(pa.string())),
                ],
                names=["key", "n_words", "spans", "items"],
            )

    return run


def scan(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, spans, items)``: where benchmark windows occur in each document.

    A window is ``size`` consecutive words of an item (a shorter item is one
    window). ``spans`` are merged runs of hit words, ``items`` the sorted ids (as
    strings) of items with an occurring window. The windows travel in a broadcast
    set of at most ``set_bytes`` of benchmark text (a single longer item goes
    alone); a larger benchmark is scanned in several passes whose spans are
    united. Null texts have no words; items without an id, text
    or words match nothing. Documents of one id are scanned row by row in a single pass; over
    several passes, rows are told apart by a row key.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = _passes(benchmark, item_col, item_text, set_bytes)
    sc = docs.sparkSession.sparkContext
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
    if len(parts) == 1:
        held = sc.broadcast([tuple(r) for r in parts[0].collect()])
        out = spread(rows).mapInArrow(_scanner(held, size), f"key {kind}, {fields}")
        return out.withColumnRenamed("key", "doc_id")
    keyed = materialise(rows.withColumn("key", F.monotonically_increasing_id()))
    found = None
    for part in parts:
        held = sc.broadcast([tuple(r) for r in part.collect()])
        one = keyed.select("key", "text").mapInArrow(_scanner(held, size), f"key long, {fields}")
        found = one if found is None else found.unionByName(one)
    united = found.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    zero = F.array().cast("array<struct<first:int,last:int>>")
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        "spans", zero,
        lambda a, s: F.when((F.size(a) > 0) & (s["first"] <= last(a)["last"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], s["last"]).alias("last")))))
        .otherwise(F.concat(a, F.array(s))),
    )
    return keyed.select("key", "doc_id").join(united.withColumn("spans", merged), "key").select("doc_id", "n_words", "spans", "items")


def judge(scanned: DataFrame, share: int = 20) -> DataFrame:
    """Counts and the verdict: contaminated when at least one word in ``share`` is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    out = scanned.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, mode: str = "documents",
    id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """``docs`` without contamination.

    ``mode="documents"`` drops contaminated documents and leaves the rest alone;
    ``mode="spans"`` cuts the hit words of contaminated documents out of their
    texts (from the first byte of a span's first word to the last of its last).
    A benchmark beyond one broadcast set is scanned in passes; rows are then told
    apart by a row key. Null texts stay. Other columns pass through.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = _passes(benchmark, options.get("item_col", "item_id"), options.get("item_text", "text"), options.get("set_bytes", SET_BYTES))
    if len(parts) > 1:
        keyed = materialise(docs.withColumn(key := unused("_row", docs.columns), F.monotonically_increasing_id()))
        found = judge(scan(keyed, benchmark, size, key, text_col, **options), share).filter("contaminated").select(F.col("doc_id").alias(key), "spans")
        if mode == "documents":
            return keyed.join(found, key, "left_anti").drop(key)
        both = keyed.join(found.withColumnRenamed("spans", spans := unused("_spans", keyed.columns)), key, "left")
        return _cut(both, text_col, spans).select(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in parts[0].collect()])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(held.value, size)
        for part in slices(batches):
            texts = part.column(place).to_pylist()
            seen = windows.scan(texts)
            bad = [sum(b - a for a, b in s) * share >= n and bool(s) for n, s, _ in seen]
            if mode == "documents":
                if not all(bad):
                    yield part.filter(pa.array([not b for b in bad]))
            else:
                texts = [cut_spans(t, s) if b else t for t, (_, s, _), b in zip(texts, seen, bad)]
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return spread(docs).mapInArrow(run, docs.schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans."""
    from coverset.llm.common import WORD_BYTES, utf8

    raw = utf8(text)
    flat = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.view(np.int8), [0]])))
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : edge[2 * first]])
        at = int(edge[2 * last - 1])
    return (b"".join(out) + raw[at:]).decode("utf-8")


def _cut(df: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    text, spans = df.columns.index(text_col), df.columns.index(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = part.column(spans).to_pylist()
            columns = list(part.columns)
            columns[text] = pa.array(
                [t if not s else cut_spans(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(part.column(text).to_pylist(), found)],
                part.schema.field(text).type,
            )
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, df.schema)
