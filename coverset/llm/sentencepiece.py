"""SentencePiece models run by the tokenizers library: encode, decode, parity."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverset.llm.common import slices, spread

SPACE = "▁"  # the metaspace marker
# Distinct units whose ids a task remembers; the memory is emptied when full.
MEMORY = 1 << 18
# Threads of the library inside a task.
THREADS = 2
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Kinds of pieces and models in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message: integers, 32-bit words as bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """What the model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        model = cls()
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
                    elif n == 44:
                        model.unk_surface = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.squeeze = bool(v)
                    elif n == 5:
                        model.escape = bool(v)
        return model

    def tokenizer(self):
        """The same model in the tokenizers library, without normaliser: texts come in normal form."""
        from tokenizers import Tokenizer, models

        unk = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unk, byte_fallback=self.byte_fallback))
        if self.kind != BPE:
            raise ValueError("only unigram and BPE models are known")
        ids = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        usable = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        merges = []
        for piece, score in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    merges.append((-score, ids[left], ids[right], left, right))
        merges.sort()
        name = self.pieces[unk][0] if unk is not None else None
        return Tokenizer(models.BPE(ids, [(m[3], m[4]) for m in merges], unk_token=name, fuse_unk=True, byte_fallback=self.byte_fallback))

    def normaliser(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        return normalizers.Sequence(steps) if steps else None

    def separable(self) -> bool:
        """No piece holds the marker after another character: a text may be cut before a run of markers."""
        return self.escape and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class Codec:
    """Encoding and decoding of whole texts; each distinct unit is encoded once and compared with the original library."""

    def __init__(self, raw: bytes, verify: bool = True, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.parse(raw)
        self.tokenizer = self.model.tokenizer()
        self.normal = self.model.normaliser()
        self.cuts = self.model.separable()
        self.memory: dict[str, tuple[bytes, bool]] = {}
        self.original = None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.surface = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                self.surface.append(self.model.unk_surface.encode())
            else:
                self.surface.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())

    def normalise(self, text: str) -> str:
        text = self.normal.normalize_str(text) if self.normal else text
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape else text

    def plain(self, unit: str) -> str:
        """The text whose normal form is this unit."""
        text = unit.replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def _learn(self, units: list[str]) -> None:
        made = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        theirs: list = [None] * len(units)
        if self.original is not None:
            theirs = self.original.encode([self.plain(u) for u in units], num_threads=1)
            for k, unit in enumerate(units):
                if unit == SPACE:  # a space at the end of a text has no text of its own
                    theirs[k] = self.original.encode("x ")[len(self.original.encode("x")) :]
        for unit, own, other in zip(units, made, theirs):
            self.memory[unit] = (np.array(own.ids, "<u4").tobytes(), other is None or own.ids == other)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether every unit agrees with the original library."""
        cut = []
        for text in texts:
            normal = self.normalise(text or "")
            cut.append(UNIT.findall(normal) if self.cuts else [normal] if normal else [])
        new = list(dict.fromkeys(u for units in cut for u in units if u not in self.memory))
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = list(dict.fromkeys(u for units in cut for u in units))
        if new:
            self._learn(new)
        out = []
        for units in cut:
            known = [self.memory[u] for u in units]
            out.append((np.frombuffer(b"".join([k[0] for k in known]), "<u4"), all([k[1] for k in known])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.surface[k] for k in ids.tolist()])
        return (raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _lists(column: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(c) for c in column])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint32), *column]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, verify: bool = True, threads: int = THREADS) -> DataFrame:
    """Columns ``keep`` (all but the text by default) with ``ids, n_tokens, ids_crc32, round_trip, parity``.

    ``round_trip``: the decoded ids are the normalised text. ``parity``: the
    sentencepiece library gives the same ids for every unit of the text; it may
    be left out (``verify=False``: always true). A null text is an empty one and
    has no ids. A kept column of one of the new names is replaced.
    """
    with open(model_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    new = StructType.fromDDL("ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
    names = {f.name for f in new.fields}
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_col]) if c.lower() not in names]
    rows = spread(docs.select(F.col(text_col).cast("string").alias("_text"), *kept))
    schema = StructType([*rows.schema.fields[1:], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(raw.value, verify, threads)
        for part in slices(batches):
            texts = part.column(0).to_pylist()
            made = codec.encode(texts)
            back = [codec.decode(ids) == codec.plain(codec.normalise(t or "")) for (ids, _), t in zip(made, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[1:], _lists([ids for ids, _ in made]), pa.array([len(ids) for ids, _ in made], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4")) for ids, _ in made], pa.int64()), pa.array(back, pa.bool_()), pa.array([ok for _, ok in made], pa.bool_()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text)``: the text of each list of ids; a null list gives null, an unknown id is an error."""
    with open(model_path, "rb") as file:
        raw = encoded.sparkSession.sparkContext.broadcast(file.read())
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(raw.value, verify=False)
        for part in slices(batches):
            texts = [None if v is None else codec.decode(np.array(v, np.int64)) for v in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
