"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import held_out, slices, spread, utf8

PAD = 256
WINDOW = 64  # bytes read together; the state starts anew in each window
HIDDEN = 8  # units of each direction
# The training sample: documents of each language, windows of each document.
DOCS_EACH, WINDOWS_EACH = 400, 6
STEPS, BATCH, RATE = 350, 96, 0.02
WINDOWS_AT_ONCE = 4096
WORDLIKE = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character of a letter category occurs; superscripts, fractions and other numerals are none."""
    return any(category(m[0])[0] == "L" for m in WORDLIKE.finditer(text))


class Network:
    """One gate each direction: f = sigmoid(E_f[x] + h U_f), c = tanh(E_c[x] + (f h) U_c), h += f (c - h)."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        self.langs = langs
        self.p = {
            "e": rng.normal(0, 0.3, (2, 257, 2 * h)), "uf": rng.normal(0, 0.3, (2, h, h)), "uc": rng.normal(0, 0.3, (2, h, h)),
            "w": rng.normal(0, 0.3, (2 * h, k)), "b": np.zeros(k),
        }
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step, ``(steps, 2, windows, hidden)``; the second direction reads from the end."""
        steps, n = x.shape
        p, size = self.p, HIDDEN
        h = np.zeros((2, n, size), np.float32)
        out = np.empty((steps, 2, n, size), np.float32)
        e = np.empty((2, n, 2 * size), np.float32)
        for t in range(steps):
            np.take(p["e"][0], x[t], axis=0, out=e[0])
            np.take(p["e"][1], x[steps - 1 - t], axis=0, out=e[1])
            f = np.matmul(h, p["uf"])
            f += e[:, :, :size]
            np.negative(f, out=f)
            np.exp(f, out=f)
            f += 1
            np.reciprocal(f, out=f)
            g = f * h
            c = np.matmul(g, p["uc"])
            c += e[:, :, size:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, f, g, c))
            d = c - h
            d *= f
            h = np.add(h, d, out=out[t])
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities at every position, ``(steps, windows, languages)``."""
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        z = both @ self.p["w"] + self.p["b"]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean log loss over all positions that hold a byte."""
        p, kept = self.p, []
        states = self.states(x, kept)
        prob = self.labels(states)
        steps, n = x.shape
        mask = (x != PAD).astype(np.float32) / max(1, int((x != PAD).sum()))
        loss = -float((np.log(prob[:, np.arange(n), y] + 1e-9) * mask).sum())
        dz = prob.copy()
        dz[:, np.arange(n), y] -= 1
        dz *= mask[:, :, None]
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["w"] = np.einsum("tni,tnk->ik", both, dz)
        grad["b"] = dz.sum(axis=(0, 1))
        dboth = dz @ p["w"].T
        size = HIDDEN
        dh = np.zeros((2, n, size), np.float32)
        for t in range(steps - 1, -1, -1):
            dh[0] += dboth[t, :, :size]
            dh[1] += dboth[steps - 1 - t, :, size:]
            h, f, g, c = kept[t]
            dc = dh * f * (1 - c * c)
            dg = dc @ p["uc"].transpose(0, 2, 1)
            df = (dh * (c - h) + dg * h) * f * (1 - f)
            grad["uc"] += g.transpose(0, 2, 1) @ dc
            grad["uf"] += h.transpose(0, 2, 1) @ df
            for side, at in ((0, t), (1, steps - 1 - t)):
                np.add.at(grad["e"][side], x[at], np.concatenate([df[side], dc[side]], axis=1))
            dh = dh * (1 - f) + dg * f + df @ p["uf"].transpose(0, 2, 1)
        return grad, loss

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        """Adam over batches with as many windows of each language."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, STEPS + 1):
            pick = np.concatenate([rng.choice(o, max(1, BATCH // len(of))) for o in of])
            grad, _ = self.gradient(np.ascontiguousarray(x[pick].T), y[pick])
            rate = RATE * (1 - step / (STEPS + 1))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each whole text."""
        total = np.zeros((len(texts), len(self.langs)))
        for who, x in _cut(texts):
            prob = self.labels(self.states(x))
            prob[x == PAD] = 0
            np.add.at(total, who, prob.sum(axis=0))
        return total / np.maximum([[len(t)] for t in texts], 1)


def _cut(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all texts, some thousands at a time, with the number of their text."""
    who, rows, count = [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, len(text), WINDOW * WINDOWS_AT_ONCE):
            raw = np.frombuffer(text[start : start + WINDOW * WINDOWS_AT_ONCE], np.uint8)
            x = np.full(-(-len(raw) // WINDOW) * WINDOW, PAD, np.int16)
            x[: len(raw)] = raw
            rows.append(x.reshape(-1, WINDOW))
            who.append(np.full(len(rows[-1]), k))
            count += len(rows[-1])
            if count >= WINDOWS_AT_ONCE:
                yield np.concatenate(who), np.ascontiguousarray(np.concatenate(rows).T)
                who, rows, count = [], [], 0
    if count:
        yield np.concatenate(who), np.ascontiguousarray(np.concatenate(rows).T)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows of a training text, at places spread over the whole of it."""
    for part in slices(batches):
        langs, out = [], []
        for lang, text, h in zip(*(part.column(i).to_pylist() for i in range(3))):
            raw = utf8(text)
            if not raw:
                continue
            rng = np.random.default_rng(h & 0xFFFFFFFF)
            for start in rng.integers(0, max(1, len(raw) - WINDOW // 2), WINDOWS_EACH).tolist():
                langs.append(lang)
                out.append(raw[start : start + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "raw"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit the network on a bounded sample of labelled rows outside the held-out third.

    About ``DOCS_EACH`` documents of each language, chosen by a hash of the id,
    give ``WINDOWS_EACH`` windows each. None if no row can be learned from.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, DOCS_EACH / n))])
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(21))
    chosen = rows.filter(F.pmod(h, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text", h.alias("h"))
    sample = chosen.mapInArrow(_windows, "lang string, raw binary").limit(2 * DOCS_EACH * WINDOWS_EACH * len(sizes)).toArrow()
    langs = sorted(set(sample["lang"].to_pylist()))
    if not langs:
        return None
    x = np.full((sample.num_rows, WINDOW), PAD, np.int16)
    for k, raw in enumerate(sample["raw"].to_pylist()):
        x[k, : len(raw)] = np.frombuffer(raw, np.uint8)
    place = {lang: k for k, lang in enumerate(langs)}
    net = Network(langs)
    net.fit(x, np.array([place[v] for v in sample["lang"].to_pylist()]))
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: every byte of every text is labelled, the mean probabilities decide.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text when nothing could be learned. Ties go to the first language by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            known = [bool(model and t and has_letter(t)) for t in texts]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if any(known):
                pooled = model.pool([utf8(t) if ok else b"" for t, ok in zip(texts, known)])
                best = pooled.argmax(axis=1)
                for k in np.flatnonzero(known).tolist():
                    lang[k], score[k] = model.langs[best[k]], min(1.0, float(pooled[k, best[k]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    made = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
