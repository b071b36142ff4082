"""Packing into fixed windows that all hold the same mixture of sources: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverset.llm.common import spread
from coverset.llm.pieces import by_bytes, piece_encoder
from coverset.session import discard, fits_broadcast, lookup_join, materialise

# Queues with a share of their own; the sources with fewer tokens wait together in one more.
MAX_QUEUES = 255
# A source with fewer tokens than this in a window has no queue of its own, unless it has a target.
LEAST_TOKENS = 32
# Windows, or places in a queue, that are worked out at a time.
CHUNK = 4_096


class Rounds:
    """What every queue has sent by the end of every window, without walking through the windows before.

    A queue with weight ``w`` earns ``w`` tokens a unit of time; its token
    number j (from 0) is due when its credit reaches j + 1/2. A window takes the
    next ``size`` tokens by due time, queues in order where they tie, so a
    queue's deficit, what it has earned less what it has sent, is carried from
    window to window and stays near one token. Queues that run empty leave their
    share to the others. The state at any window follows from the time at which
    so many tokens are due, so tasks start anywhere with the deficits that the
    windows before have left.
    """

    def __init__(self, weights: np.ndarray, lengths: np.ndarray, size: int):
        self.weights, self.lengths, self.size = weights.astype(np.float64), lengths.astype(np.int64), size
        self.total = int(self.lengths.sum())
        self.windows = -(-self.total // size)
        # Tokens due over time without the rounding: straight between the moments at which queues run empty.
        ends = np.where(self.lengths > 0, self.lengths / self.weights, 0.0)
        self.times = np.concatenate([[0.0], np.unique(ends[self.lengths > 0])])
        self.due = np.array([np.minimum(self.weights * t, self.lengths).sum() for t in self.times])

    def _at(self, t: np.ndarray) -> np.ndarray:
        """Tokens due by each time: whole numbers ``[time, queue]``."""
        return np.minimum(np.floor(t[:, None] * self.weights + 0.5).astype(np.int64), self.lengths)

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent in the first ``windows`` windows: ``[windows, queue]``."""
        goal = np.minimum(windows.astype(np.int64) * self.size, self.total)
        slack = len(self.weights) + 1.0
        low = np.interp(goal - slack, self.due, self.times) * (1 - 1e-9)
        high = np.interp(goal + slack, self.due, self.times) * (1 + 1e-9) + 1.0 / self.weights.min()
        # Bisection on the bits of the times ends at neighbouring floats.
        low, high = low.view(np.int64), high.view(np.int64)
        while (open_ := high - low > 1).any():
            middle = low + (high - low) // 2
            few = self._at(middle.view(np.float64)).sum(axis=1) <= goal
            low, high = np.where(open_ & few, middle, low), np.where(open_ & ~few, middle, high)
        base, more = self._at(low.view(np.float64)), self._at(high.view(np.float64))
        # Tokens due at one time go by the order of the queues.
        spare, room = goal - base.sum(axis=1), more - base
        before = np.cumsum(room, axis=1) - room
        return base + np.clip(spare[:, None] - before, 0, room)

    def window_of(self, queue: int, places: np.ndarray) -> np.ndarray:
        """The window that sends each of a queue's tokens ``places``."""
        return np.concatenate([self._windows(queue, places[k : k + CHUNK]) for k in range(0, max(len(places), 1), CHUNK)])

    def _windows(self, queue: int, places: np.ndarray) -> np.ndarray:
        t = (places + 0.5) / self.weights[queue]
        guess = np.clip(self._at(t).sum(axis=1) // self.size, 0, max(self.windows - 1, 0))
        while True:
            known, back = np.unique(np.concatenate([guess, guess + 1]), return_inverse=True)
            sent = self.sent(known)[:, queue][back]
            early, late = sent[: len(guess)], sent[len(guess) :]
            step = np.where(places < early, -1, np.where(places >= late, 1, 0))
            if not step.any():
                return guess
            guess = guess + step


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, n, part, before, ids)``: the ids of each document, and those of its source before it in its part.

    A part is what one task has written; ``before`` is counted in it. The table
    is written, so that the order of the queues outlives a lost executor.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        description = file.read()  # a vocabulary's size, whatever the corpus
    small = max(Tokenizer.from_str(description).get_vocab_size(), end_id + 1) <= 1 << 16
    held = docs.sparkSession.sparkContext.broadcast(description)
    width = "<u2" if small else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop, part = piece_encoder(held.value), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        waiting: dict[str, int] = {}
        for rows in by_bytes(batches, 2):
            made = [np.concatenate([x, stop]) for x in known.encode(rows.column(2))]
            before = []
            for source, ids in zip(rows.column(1).to_pylist(), made):
                at = waiting.get(source, 0)
                before.append(at)
                waiting[source] = at + len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), rows.column(1), pa.array([len(x) for x in made], pa.int64()), pa.array([part] * len(made), pa.int64()),
                    pa.array(before, pa.int64()), pa.array([x.astype(width).tobytes() for x in made], pa.binary()),
                ],
                names=["doc_id", "source", "n", "part", "before", "ids"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    made = spread(rows).mapInArrow(run, "doc_id long, source string, n long, part long, before long, ids binary")
    return materialise(made.withColumn("wide", F.lit(0 if small else 1)))


def queue_starts(runs: DataFrame) -> DataFrame:
    """``runs`` ``(queue, part, source, n)`` with ``start``, the tokens of the queue before each run.

    One running total over all runs, ordered by queue: tasks add up their own
    range, the ranges before it are one small row each, and so are the queues.
    """
    order = runs.repartitionByRange("queue", "part", "source").sortWithinPartitions("queue", "part", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - n), pa.array(np.full(len(n), piece))], names=[*batch.schema.names, "inner", "piece"]
            )
            at = int(ends[-1]) if len(n) else at

    placed = materialise(order.select("queue", "part", "source", "n").mapInArrow(run, "queue int, part long, source string, n long, inner long, piece long"))
    before = F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    pieces = placed.groupBy("piece").agg(F.sum("n").alias("n")).select("piece", F.coalesce(before, F.lit(0)).alias("outer"))
    whole = placed.join(F.broadcast(pieces), "piece").withColumn("all", F.col("inner") + F.col("outer"))  # a row for each partition
    first = whole.groupBy("queue").agg(F.min("all").alias("first"))
    return whole.join(F.broadcast(first), "queue").select("part", "source", "queue", (F.col("all") - F.col("first")).alias("start"))  # 256 queues


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 4_096,
    end_id: int = 2,
    targets: Mapping[str, float] | None = None,
    max_queues: int = MAX_QUEUES,
    least_tokens: int = LEAST_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source)`` of windows of ``size`` tokens.

    Every source is a queue of its documents' tokens, each document closed by
    ``end_id``. A window takes tokens of the queues in proportion to ``targets``
    (source to weight); what rounding leaves over is carried to the next window
    as a deficit. A source without a target keeps its own share of the tokens,
    as all do by default: then the queues run empty together and every window has the
    corpus's mixture. A queue that runs empty leaves its share to the others, so
    all windows are full but the last, and each token lies in one piece.

    The ``max_queues`` sources with the most tokens have queues of their own
    (named targets first); those of them that would get fewer than ``least_tokens``
    tokens in a window, and all others, wait in one queue more, so that documents
    are not cut into crumbs. A queue's order is
    that of its rows in the encoded table. Windows are worked out in each task
    for its own pieces; no task holds a queue or walks through the windows.

    A null text is empty: the end id alone. Null sources are one source. Null
    and repeated ids are a document each time. An empty table has no pieces.
    ``with_ids`` adds the piece's ids as bytes, little-endian, 4 each.
    """
    rows = encode(docs, tokenizer, end_id, id_col, text_col, source_col)
    runs = materialise(rows.groupBy("part", "source").agg(F.sum("n").alias("n")))
    by_source = runs.groupBy("source").agg(F.sum("n").alias("n"))
    aims = {str(k): float(v) for k, v in (targets or {}).items()}
    if any(not v > 0 or v == float("inf") for v in aims.values()):
        raise ValueError("a target is a positive number")
    named = F.col("source").isin(*aims) if aims else F.lit(False)
    largest = by_source.orderBy(named.desc(), F.col("n").desc(), "source").limit(max_queues).collect()
    total = by_source.agg(F.sum("n").alias("n")).first()["n"] or 0
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    schema += ", ids binary" if with_ids else ""
    largest = [r for r in largest if r.source in aims or r.n * size >= least_tokens * total]
    lengths = [r.n for r in largest]
    rest = total - sum(lengths)
    if rest:
        lengths.append(rest)
    if not total:
        return docs.sparkSession.createDataFrame([], schema)
    aimed = sum(aims.get(r.source, 0.0) for r in largest)
    scale = aimed / max(sum(r.n for r in largest if r.source in aims), 1) if aimed else 1.0
    weights = [aims.get(r.source, r.n * scale) for r in largest] + ([rest * scale] if rest else [])
    plan = Rounds(np.array(weights) / max(weights), np.array(lengths), size)
    names = docs.sparkSession.createDataFrame([(r.source, k) for k, r in enumerate(largest)], "source string, queue int")
    queued = runs.join(F.broadcast(names), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(largest))))  # at most max_queues rows
    starts = materialise(queue_starts(queued))
    if fits_broadcast(starts, 128):
        placed = rows.join(F.broadcast(starts), ["part", "source"])
    else:
        key = lambda t: t.withColumn("run", F.xxhash64("part", "source")).drop("part")
        placed = lookup_join(key(rows), key(starts).withColumnRenamed("source", "of"), "run", "before", 128).filter("source = of")
    placed = placed.select("doc_id", "source", "n", "queue", (F.col("start") + F.col("before")).alias("place"), "ids", "wide")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 5):
            yield from cut_slice(batch)

    def cut_slice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, queue, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        first, last = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for q in np.unique(queue).tolist():
            mine = np.flatnonzero(queue == q)
            found = plan.window_of(q, np.concatenate([place[mine], place[mine] + n[mine] - 1]))
            first[mine], last[mine] = found[: len(mine)], found[len(mine) :]
        # Where a queue sends less than a token a window, the windows of each token; else all from the first to the last.
        rare = last - first >= n
        span = np.where(rare, 0, last - first + 1)
        row = np.repeat(np.arange(len(n)), span)
        window = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span) + first[row]
        for k in np.flatnonzero(rare).tolist():
            found = np.unique(plan.window_of(int(queue[k]), place[k] + np.arange(n[k])))
            row, window = np.concatenate([row, np.full(len(found), k)]), np.concatenate([window, found])
        order = np.argsort(window, kind="stable")
        low, high, offset = (np.empty(len(row), np.int64) for _ in range(3))
        used = np.unique(window)
        for at in range(0, len(used), CHUNK):
            some = used[at : at + CHUNK]
            lo, hi = np.searchsorted(window[order], [some[0], some[-1] + 1])
            pick = order[lo:hi]
            begun, ended = plan.sent(some), plan.sent(some + 1)
            where, q = np.searchsorted(some, window[pick]), queue[row[pick]]
            low[pick] = np.maximum(begun[where, q], place[row[pick]])
            high[pick] = np.minimum(ended[where, q], place[row[pick]] + n[row[pick]])
            takes = ended - begun
            offset[pick] = (np.cumsum(takes, axis=1) - takes)[where, q] + low[pick] - begun[where, q]
        # A long document may pass over windows in which its queue sends nothing.
        held = np.flatnonzero(high > low)
        row, window, low, high, offset = row[held], window[held], low[held], high[held], offset[held]
        width = "<u4" if len(n) and batch.column(6)[0].as_py() else "<u2"
        starts, ends = (low - place[row]), (high - place[row])
        crc, bodies, now, ids = [], [], -1, b""
        column = batch.column(5)
        for k, lo, hi in zip(row.tolist(), (4 * starts).tolist(), (4 * ends).tolist()):
            if k != now:
                now, ids = k, memoryview(np.frombuffer(column[k].as_buffer(), width).astype("<u4").tobytes())
            crc.append(zlib.crc32(ids[lo:hi]))
            if with_ids:
                bodies.append(bytes(ids[lo:hi]))
        who = pa.array(row)
        arrays = [batch.column(0).take(who), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()), batch.column(2).take(who)]
        arrays += [pa.array(window), pa.array(offset), batch.column(1).take(who)] + ([pa.array(bodies, pa.binary())] if with_ids else [])
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    discard(runs)
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed windows of ``pack(..., with_ids=True)``, at most a window's ids in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda made, p: F.concat(made, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
