"""Quality by co-training: a content view and a page-metadata view teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import append, fit_logistic, held_out, logistic, spread, unused, utf8
from coverset.session import discard, materialise

# Labelled rows of the fit at most, by a hash of the id.
LABELLED_ROWS = 6_000
# In each round either view teaches the other its surest rows among all unlabelled ones, so many of each class at most, from this calibrated confidence on.
ROUNDS, CONFIDENT, TAUGHT = 3, 0.97, 600
PAIRS = 96  # hashed byte pairs of the content view
LAYOUT = PAIRS + 6  # where the content view's sizes, lines and compression begin
# Ridge of the byte pairs and of everything else (chosen by cross-validation inside the training rows).
PAIR_RIDGE, RIDGE = 20.0, 1.0
SOURCES, LANGS = 16, 8  # hashed values of the metadata view
ACCEPT = 0.5
_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS


def content_view(text: str | None) -> np.ndarray:
    """What the text says: byte pairs, repetition, character classes, layout, how far it packs."""
    raw = utf8(text)
    out = np.zeros(LAYOUT + 5)
    if not raw:
        return out
    lines = raw.count(b"\n") + 1
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[s : s + (1 << 20)])) for s in range(0, len(raw), 1 << 20)) + len(packer.flush())
    out[LAYOUT:] = np.log1p(len(raw)), np.log1p(lines), np.log1p(len(raw) / lines), packed / (len(raw) + 20), np.log1p(packed)
    for start in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[start : start + (1 << 20) + 1], np.uint8).astype(np.int64)
        out[:PAIRS] += np.bincount(_PAIR[(b[:-1] << 8) | b[1:]], minlength=PAIRS)
        out[PAIRS + 2] += ((b >= 65) & (b <= 90)).sum()
        out[PAIRS + 3] += ((b >= 48) & (b <= 57)).sum()
        out[PAIRS + 4] += ((b > 32) & (b < 48) | (b > 57) & (b < 65) | (b > 90) & (b < 97) | (b > 122) & (b < 127)).sum()
    found = raw.split()
    out[PAIRS] = sum(map(bytes.__eq__, found[1:], found[:-1])) / max(1, len(found) - 1)
    out[PAIRS + 1] = len(set(found)) / max(1, len(found)) ** 0.8
    out[:PAIRS] = np.sqrt(out[:PAIRS] / max(1, len(raw) - 1))
    out[PAIRS + 2 : PAIRS + 5] /= len(raw)
    out[PAIRS + 5] = np.log1p(len(found))
    return out


def page_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """What is known of the page without its text: source, language and stated size."""
    size = np.log1p(max(0, n_chars or 0))
    out = np.zeros(SOURCES + LANGS + 3)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[SOURCES + LANGS :] = size, size * size, n_chars is None
    return out


@dataclass
class Model:
    content: tuple
    page: tuple
    combine: tuple

    def score(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        return logistic(self.combine, _logits(self.content, self.page, content, page))


def _logits(content_model, page_model, content: np.ndarray, page: np.ndarray) -> np.ndarray:
    p = np.clip(np.stack([logistic(content_model, content), logistic(page_model, page)], axis=1), 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class CoTraining:
    """The training rows of both views, which grow by what the other view teaches.

    ``y`` is 0 or 1, ``aside`` marks rows that only calibrate and combine the
    views. Rows count so that both classes weigh the same.
    """

    def __init__(self, content: np.ndarray, page: np.ndarray, y: np.ndarray, aside: np.ndarray):
        self.views, self.y, self.aside = (content, page), y, aside
        self.rows = [content[~aside], page[~aside]]
        self.marks = [y[~aside].astype(float), y[~aside].astype(float)]

    def ready(self) -> bool:
        return len(set(self.marks[0].tolist())) == 2

    def fit(self) -> list:
        models = []
        for x, y in zip(self.rows, self.marks):
            weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
            ridge = np.full(x.shape[1] + 1, RIDGE)
            if x.shape[1] > LAYOUT:
                ridge[:PAIRS] = PAIR_RIDGE
            models.append(fit_logistic(x, y, weight, ridge=ridge))
        return models

    def teachers(self) -> list:
        """Both views with a calibration on rows that they were not fitted on: a view that knows little is sure of nothing."""
        models, use = self.fit(), self._apart()
        logits = _logits(*models, self.views[0][use], self.views[1][use])
        return [(m, fit_logistic(logits[:, v : v + 1], self.y[use].astype(float))) for v, m in enumerate(models)]

    def _apart(self) -> np.ndarray:
        return self.aside if len(set(self.y[self.aside].tolist())) == 2 else np.ones(len(self.y), bool)

    def teach(self, pupil: int, rows: np.ndarray, mark: int) -> None:
        if len(rows):
            self.rows[pupil] = np.concatenate([self.rows[pupil], rows])
            self.marks[pupil] = np.concatenate([self.marks[pupil], np.full(len(rows), float(mark))])

    def combined(self) -> Model:
        models, use = self.fit(), self._apart()
        return Model(models[0], models[1], fit_logistic(_logits(*models, self.views[0][use], self.views[1][use]), self.y[use].astype(float)))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float)


def _surest(teachers: list, done: list[set], each: tuple[int, int]):
    """For every task the surest rows of each view (0, 1) and class (``each`` of it): ``(teacher, mark, sure, tie, row, content, page)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row = batch.column(0).to_numpy()
            views = [_matrix(batch.column(k), batch.num_rows) for k in (2, 3)]
            for v in (0, 1):
                model, calibration = teachers[v]
                raw = np.clip(logistic(model, views[v]), 1e-6, 1 - 1e-6)
                p = logistic(calibration, np.log(raw / (1 - raw))[:, None])
                fresh = ~np.isin(row, list(done[1 - v])) if done[1 - v] else np.ones(len(row), bool)
                for mark, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(fresh & (sure >= CONFIDENT))
                    if not len(at):
                        continue
                    some = pa.table({"sure": sure[at], "tie": batch.column(1).take(pa.array(at)), "row": row[at], "content": batch.column(2).take(pa.array(at)), "page": batch.column(3).take(pa.array(at))})
                    held = pa.concat_tables([best[v, mark], some]) if (v, mark) in best else some
                    best[v, mark] = held.sort_by([("sure", "descending"), ("tie", "ascending"), ("row", "ascending")]).slice(0, each[mark])
        for (v, mark), held in best.items():
            n = held.num_rows
            made = pa.table({"teacher": pa.array([v] * n, pa.int32()), "mark": pa.array([mark] * n, pa.int32()), **{c: held[c] for c in held.column_names}})
            yield from made.combine_chunks().to_batches()
        best.clear()
        pa.default_memory_pool().release_unused()

    return run


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns that the views read; those that ``docs`` lacks are null."""
    have = {c.lower() for c in docs.columns}
    extra = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)


def _views(columns: list) -> list:
    return [[content_view(t).tolist() for t in columns[0]], [page_view(*row).tolist() for row in zip(*columns[1:])]]


READ = ["text", "source", "lang", "n_chars"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 31) -> Model | None:
    """Fit on at most ``LABELLED_ROWS`` labelled rows outside the held-out third, and on all unlabelled ones.

    The features of every row are written once. In each round one pass scores
    all rows without a chosen label by both views; every task keeps its surest
    rows, and the surest ``TAUGHT`` of them for each view and class become
    training rows of the other view. None without labels of both classes.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("mark"))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = materialise(marks.filter(~held_out()).orderBy(order, "doc_id").limit(LABELLED_ROWS))
    if chosen.isEmpty():
        return None
    # At most LABELLED_ROWS rows of two numbers.
    rows = spread(_inputs(docs, id_col, text_col)).join(F.broadcast(chosen), "doc_id", "left")
    made = append(rows, "content array<float>, page array<float>", _views, READ)
    keep = made.select("doc_id", "mark", "content", "page", F.monotonically_increasing_id().alias("row"))
    features = materialise(keep.withColumns({"aside": F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(4)) == 0, "tie": F.xxhash64("doc_id", F.lit(seed + 1))}))
    known = features.filter("mark IS NOT NULL").orderBy(order, "doc_id", "row").limit(2 * LABELLED_ROWS).toArrow()
    if not known.num_rows:
        return None
    n = known.num_rows
    state = CoTraining(_matrix(known["content"], n), _matrix(known["page"], n), known["mark"].to_numpy(), known["aside"].to_numpy(zero_copy_only=False))
    if not state.ready():
        return None
    free, done = features.filter("mark IS NULL").select("row", "tie", "content", "page"), [set(), set()]
    fields = "teacher int, mark int, sure double, tie long, row long, content array<float>, page array<float>"
    # A round teaches no more rows of a class than are known of it.
    each = tuple(min(TAUGHT, int((state.marks[0] == mark).sum())) for mark in (0, 1))
    for _ in range(ROUNDS):
        sure = materialise(free.mapInArrow(_surest(state.teachers(), done, each), fields))
        lessons = [
            (v, mark, sure.filter((F.col("teacher") == v) & (F.col("mark") == mark)).orderBy(F.col("sure").desc(), "tie", "row").limit(each[mark]).toArrow())
            for v in (0, 1) for mark in (0, 1)
        ]
        discard(sure)
        if not any(lesson.num_rows for _, _, lesson in lessons):
            break
        for v, mark, lesson in lessons:
            pupil = 1 - v
            if lesson.num_rows:
                state.teach(pupil, _matrix(lesson[("content", "page")[pupil]], lesson.num_rows), mark)
                done[pupil].update(lesson["row"].to_pylist())
    discard(features)
    return state.combined()


def _judge(held):
    def compute(columns: list) -> list:
        model, n = held.value, len(columns[0])
        if model is None or not n:
            return [[1.0] * n]
        content = np.array([content_view(t) for t in columns[0]])
        page = np.array([page_view(*row) for row in zip(*columns[1:])])
        return [model.score(content, page).tolist()]

    return compute


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, accepted)`` for every row: the combined, calibrated views on the whole text.

    Null and empty texts are scored by their metadata and zero features. Missing
    metadata columns count as null. Without labels of both classes every score is 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = append(spread(_inputs(docs, id_col, text_col)), "score double", _judge(held), READ)
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("accepted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored below ``ACCEPT``; all columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    have = {c.lower() for c in docs.columns}
    name = unused("_quality_score", docs.columns)
    temp = [unused(f"_q_{k}", docs.columns) for k in range(4)]
    full = spread(docs).withColumns({
        temp[0]: F.col(text_col).cast("string"),
        **{t: (F.col(c) if c in have else F.lit(None)).cast(kind) for t, c, kind in zip(temp[1:], READ[1:], ("string", "string", "long"))},
    })
    return append(full, f"{name} double", _judge(held), temp).filter(F.col(name) >= ACCEPT).drop(name, *temp)
