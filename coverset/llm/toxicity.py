"""Toxicity by two class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import append, fit_logistic, held_out, slices, spread, unused, words
from coverset.session import fits_broadcast, lookup_join, materialise

# Absolute discount; weight in counts of what a word, and a beginning, fall back on; log factor that an expression must stand out by.
# The last three by two-fold cross-validation inside the training rows (no held-out row): F1 at REJECT 0.967 on sf0.1.
DISCOUNT, BACKOFF, STEM_BACKOFF, CONTRAST = 0.75, 2.0, 4.0, 1.4
# Beginnings of a word that it falls back on, in characters.
STEMS = (4, 5, 6, 7, 8)
# Labelled rows (never counted by the models) that calibrate the score, at most.
CALIBRATION_ROWS = 20_000
REJECT = 0.7
# Words whose ratio a task remembers.
MEMORY = 200_000
# Expressions with a ratio that travel to the tasks as two arrays (12 bytes each); a larger model is joined by word.
MODEL_BYTES, RATIO_BYTES = 48 * 1024 * 1024, 12


@dataclass
class Model:
    """Log ratios by word or beginning, either as sorted arrays or, beyond ``MODEL_BYTES``, as a table ``(word, ratio)``.

    A word counts with its own ratio or else that of its longest beginning that has one.

    ``calibration`` is None when no class is known.
    """

    words: np.ndarray
    ratios: np.ndarray
    table: DataFrame | None = None
    calibration: tuple | None = None


def _codes(text: str | None) -> np.ndarray:
    """A 63-bit hash for each word of the lower-cased text."""
    found = words(text.lower()) if text else []
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) >> np.uint64(1)).astype(np.int64)


def _stems(word: bytes) -> list[bytes]:
    """The beginnings of a word, longest first."""
    text = word.decode("utf-8", "replace")
    return [text[:k].encode("utf-8", "replace") for k in reversed(STEMS) if k <= len(text)]


def _chains(found: list[bytes]) -> np.ndarray:
    """A row of hashes for each word: its own and those of its beginnings (as ``F.xxhash64`` has them), then the own again."""
    own = xxhash.xxh3_64_intdigest
    rows = [[own(w) >> 1, *(xxhash.xxh64_intdigest(s, seed=42) for s in _stems(w))] for w in found]
    width = len(STEMS) + 1
    return np.array([r + r[:1] * (width - len(r)) for r in rows], np.uint64).reshape(-1, width).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word, its longest beginning, and the word before it, whose lowest bit is replaced by the class; each once a slice."""
    for part in slices(batches):
        pairs, stems = [], {}
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            codes = _codes(text)
            stems.update((c, w) for c, w in zip(codes.tolist(), words(text.lower()) if text else []))
            before = np.concatenate([np.zeros(1, np.int64), codes[:-1]])[: len(codes)]
            pairs.append(np.stack([codes, before & ~1 | int(toxic)]))
        if pairs:
            word, context = np.concatenate(pairs, axis=1)
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
            word, context = word[fresh], context[fresh]
            longest = {c: next(iter(_stems(w)), b"").decode("utf-8", "replace") for c, w in stems.items()}
            stem = pa.array([longest[c] for c in word.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(context), stem], names=["word", "context", "stem"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row key, each different word of the row, how often it stands there, and each hash that it may count with; rank 0 is the word's own."""
    for part in slices(batches, 32):
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = Counter(words(text.lower()) if text else [])
            chains = _chains(list(found))
            rank = np.tile(np.arange(chains.shape[1]), len(chains))
            own, n = np.repeat(chains[:, 0], chains.shape[1]), np.repeat(np.fromiter(found.values(), np.int64, len(found)), chains.shape[1])
            code = chains.reshape(-1)
            keep = (rank == 0) | (code != own)
            columns = [np.full(len(code), key, np.int64), own, n, rank, code]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["row", "own", "n", "rank", "word"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_cols: list[str]) -> DataFrame:
    """Rows of ``docs`` outside the held-out third that have a label (the largest, where an id has several)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_cols)
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("mark"))
    marks = materialise(marks.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return lookup_join(rows, marks, "doc_id", "doc_id", 64)


def _share(toxic: str, plain: str, parent: Column, weight: float, backoff: float) -> Column:
    """The share of toxic texts in an expression's counts, the classes weighing the same, smoothed by its parent's share."""
    t = F.greatest(F.col(toxic) - DISCOUNT, F.lit(0.0))
    p = F.greatest(F.col(plain) - DISCOUNT, F.lit(0.0)) * weight
    return (t + backoff * parent) / (t + p + backoff)


def _ratio(share: Column) -> Column:
    """What stands out, and 0 for the rest."""
    return F.greatest(F.log(share / (1.0 - share)) - CONTRAST, F.lit(0.0))


def _levels(counts: DataFrame) -> DataFrame:
    """``(stem, share, above)`` of every beginning: its smoothed toxic share and that of the beginning one character shorter.

    A beginning is counted by the number of different words that have it in each class.
    """
    seen = counts.select("stem", (F.col("toxic") > 0).cast("long").alias("t"), (F.col("plain") > 0).cast("long").alias("p"))
    seen = seen.filter(F.length("stem") > 0).groupBy("stem").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    each = seen.withColumn("size", F.explode(F.sequence(F.lit(STEMS[0]), F.length("stem"))))
    each = each.groupBy(F.expr("left(stem, size)").alias("stem"), "size").agg(F.sum("t").alias("toxic"), F.sum("p").alias("plain"))
    each = materialise(each)
    weights = {r["size"]: r["t"] / max(r["p"], 1) for r in each.groupBy("size").agg(F.sum("toxic").alias("t"), F.sum("plain").alias("p")).collect()}
    out = above = None
    for size in STEMS:
        rows = each.filter(F.col("size") == size)
        if above is None:
            rows = rows.withColumn("above", F.lit(0.5))
        else:
            rows = rows.join(above.select(F.col("stem").alias("_shorter"), F.col("share").alias("above")), F.expr("left(stem, size - 1)") == F.col("_shorter"))
        above = materialise(rows.select("stem", _share("toxic", "plain", F.col("above"), weights.get(size, 1.0), STEM_BACKOFF).alias("share"), "above"))
        out = above if out is None else out.unionByName(above)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_bytes: int = MODEL_BYTES) -> Model:
    """Count contexts of every expression in every labelled training document, and calibrate.

    The probability of a word in a class follows its Kneser-Ney continuation
    count (the number of different words before it in that class), less a
    discount, and falls back on the word's beginnings of 8 to 4 characters. A
    beginning follows its own continuation count (the number of different words
    that have it in that class), and the shortest falls back on a share that is
    the same in both classes. So a rare or unseen form of a stem counts as the
    stem does. Contrast: an expression keeps the common estimate unless it is
    that much likelier in toxic texts, so that sampling noise and the mix of
    languages do not add up over a long text.
    Every expression has a count of its own, so the model grows with the corpus:
    up to ``model_bytes`` the ratios travel to the tasks, beyond that the words
    of the documents are joined with them; the scores are the same.
    A quarter of the training rows is not counted and calibrates the score
    (at most ``CALIBRATION_ROWS`` of them).
    """
    text = F.col(text_col).cast("string").alias("text")
    rows = labelled(docs, labels, "toxic", id_col, [text])
    aside = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    pairs = rows.filter(~aside).select("text", "mark").mapInArrow(_contexts, "word long, context long, stem string").distinct()
    counts = pairs.groupBy("word", "stem").agg(F.sum(F.col("context").bitwiseAND(F.lit(1))).alias("toxic"), F.count(F.lit(1)).alias("every"))
    counts = materialise(counts.select("word", "stem", "toxic", (F.col("every") - F.col("toxic")).alias("plain")))
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("plain").alias("o")).first()
    model = Model(np.empty(0, np.int64), np.empty(0, np.float32))
    if not totals["t"] or not totals["o"]:
        return model
    share = totals["t"] / totals["o"]
    stems = _levels(counts)
    parents = stems.select("stem", F.col("share").alias("above"))
    own = counts.join(parents, "stem", "left").withColumn("above", F.coalesce("above", F.lit(0.5))).withColumn("share", _share("toxic", "plain", F.col("above"), share, BACKOFF))
    found = own.select("word", "share", "above").unionByName(stems.select(F.xxhash64("stem").alias("word"), "share", "above"))
    # A ratio of 0 is kept where the shorter beginning has one that it overrules.
    found = found.select("word", _ratio(F.col("share")).cast("float").alias("ratio"), _ratio(F.col("above")).alias("shorter"))
    found = materialise(found.filter("ratio > 0 OR shorter > 0").select("word", "ratio"))
    if fits_broadcast(found, RATIO_BYTES, model_bytes):
        table = found.toArrow().sort_by("word")
        model.words, model.ratios = table["word"].to_numpy(), table["ratio"].to_numpy()
    else:
        model.table = found
    known = _weighed(rows.filter(aside), model, "text", "delta", "length")
    sample = known.select("doc_id", "mark", "delta", "length").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "delta").limit(CALIBRATION_ROWS).toArrow()
    y = sample["mark"].to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        model.calibration = fit_logistic(np.stack([sample["delta"].to_numpy(), sample["length"].to_numpy()], axis=1), y)
    return model


def _weigh(held):
    memory: dict[bytes, float] = {}

    def learn(fresh: list[bytes]) -> None:
        known, ratios = held.value
        if not len(known):
            memory.update(dict.fromkeys(fresh, 0.0))
            return
        chains = _chains(fresh)
        at = np.minimum(np.searchsorted(known, chains), len(known) - 1)
        hit = known[at] == chains
        first = hit.argmax(axis=1)
        rows = np.arange(len(fresh))
        memory.update(zip(fresh, np.where(hit.any(axis=1), ratios[at[rows, first]], 0.0).astype(float).tolist()))

    def compute(columns: list) -> list:
        deltas, lengths = [], []
        if len(memory) > MEMORY:
            memory.clear()
        for text in columns[0]:
            found = words(text.lower()) if text else []
            fresh = list(set(found).difference(memory))
            if fresh:
                learn(fresh)
            deltas.append(float(np.sqrt(sum(map(memory.__getitem__, found)) / max(len(found), 1))))
            lengths.append(float(np.log1p(len(found))))
        return [deltas, lengths]

    return compute


def _weighed(rows: DataFrame, model: Model, text_col: str, delta: str, length: str) -> DataFrame:
    """``rows`` with the root of toxic minus ordinary log-likelihood for each word (a few strong texts do not set the scale), and the log of the length."""
    if model.table is None:
        held = rows.sparkSession.sparkContext.broadcast((model.words, model.ratios))
        return append(spread(rows), f"{delta} double, {length} double", _weigh(held), [text_col])
    key, total = unused("_row", rows.columns), unused("_total", rows.columns)
    keyed = materialise(rows.withColumn(key, F.monotonically_increasing_id()))
    counts = keyed.select(key, F.col(text_col).cast("string")).mapInArrow(_word_counts, "row long, own long, n long, rank long, word long")
    best = lookup_join(counts, model.table, "word", "row", 64).groupBy("row", "own").agg(F.min(F.struct("rank", "ratio", "n")).alias("best")).select("row", "best.*")
    sums = best.groupBy(F.col("row").alias(key)).agg(F.sum(F.col("n") * F.col("ratio").cast("double")).alias(total))
    sized = append(keyed, f"{length} double", lambda c: [[float(np.log1p(len(words(t.lower() if t else t)))) for t in c[0]]], [text_col])
    per_word = F.coalesce(F.col(total), F.lit(0.0)) / F.greatest(F.round(F.expm1(length)), F.lit(1.0))
    return sized.join(sums, key, "left").withColumn(delta, F.sqrt(per_word)).select(*rows.columns, delta, length)


def _probability(model: Model, delta: str, length: str) -> Column:
    if model.calibration is None:
        return F.lit(0.0)
    mean, scale, w = (v.tolist() for v in model.calibration)
    z = F.lit(w[-1])
    for k, name in enumerate((delta, length)):
        z = z + (F.col(name) - mean[k]) / scale[k] * w[k]
    return 1.0 / (1.0 + F.exp(-z))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; only the text is looked at.

    Null and empty texts have no words and get the score of a text of length
    zero. Without labels of both classes the score is 0 everywhere. A null id is
    not held out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = _weighed(rows, model, "text", "delta", "length").withColumn("score", _probability(model, "delta", "length"))
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored ``REJECT`` or more; all columns stay as they are."""
    model = train(docs, labels, id_col, text_col)
    a, b = unused("_delta", docs.columns), unused("_length", docs.columns)
    return _weighed(docs, model, text_col, a, b).filter(_probability(model, a, b) < REJECT).drop(a, b)
