"""Token ids of many whole texts: cut and counted in Arrow, each distinct piece encoded once by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces that a worker remembers: two generations of so many, about 200 bytes each.
GENERATION = 200_000
# Text bytes taken at a time and pieces whose ids are gathered at a time.
SLICE_BYTES = 4_000_000
GATHER = 1 << 18

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(rf" ?[{LETTERS}]+")
# After these characters a full stop or comma starts a piece in every byte-level pattern.
BEFORE_MARK = f"[0-9{LETTERS}]$"

# The contraction pattern of the word vocabulary (a fixed value of its file).
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free letter from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


def kind_of(description: str) -> str:
    """``byte`` (spaces belong to the next piece), ``word`` (white space is dropped) or ``whole`` (no cut is known)."""
    made = json.loads(description)
    before, cut = made.get("normalizer"), made.get("pre_tokenizer") or {}
    if any(" " in t["content"] for t in made.get("added_tokens", [])):
        return "whole"
    if before is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
        return "byte"
    steps = cut.get("pretokenizers", [])
    splits = [s for s in steps if s["type"] == "Split" and s.get("pattern") == {"Regex": WORD_PATTERN} and s["behavior"] == "Removed"]
    names = [n["type"] for n in (before or {}).get("normalizers", [])]
    if len(steps) == 2 and len(splits) == 1 and steps[1]["type"] == "ByteLevel" and names == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "whole"


class PieceEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Arrow cuts the texts at spaces, line breaks, full stops and commas and
    dictionary-encodes the pieces, so that the work in Python is one lookup for
    each distinct piece of a slice; numpy gathers the ids. Texts in which such a
    cut might not be one of the tokenizer's own (marks or white space side by
    side) are cut at spaces only, and encoded whole where even that is not sure,
    or where a special token meets white space that counts. Vocabularies of
    other kinds than ``kind_of`` knows are encoded text by text.
    """

    def __init__(self, description: str, special: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.kind = kind_of(description)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = names
        if any("." in n or "," in n or "\n" in n for n in names):
            self.kind = "whole"
        self.stand_in = str.maketrans(byte_letters())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        others, young, tokenize, stand_in, lower = [], self.young, self.model.tokenize, self.stand_in, self.kind == "word"
        word = WORD.fullmatch
        for piece in pieces:
            if piece.isascii() and piece.isalpha():  # such letters stand for themselves
                young[piece] = array("I", [t.id for t in tokenize(piece.lower() if lower else piece)]).tobytes()
            elif word(piece):
                text = piece.lower() if lower else piece
                made = tokenize("Ġ" + text[1:] if text.isascii() else text.encode().decode("latin-1").translate(stand_in))
                young[piece] = array("I", [t.id for t in made]).tobytes()
            else:
                others.append(piece)
        for piece, made in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            young[piece] = array("I", made.ids).tobytes()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = [p for p in pieces if p not in young]
        if missing:
            new = []
            for piece in missing:
                if piece in old:
                    young[piece] = old[piece]
                else:
                    new.append(piece)
            self._learn(new)
        return [young[p] for p in pieces]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _cut(self, texts: pa.Array, fine: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text by its pieces, and which texts need a coarser cut."""
        byte = self.kind == "byte"
        body = texts
        if byte:
            body = pc.replace_substring(body, " ", "\0 ")
            if fine:
                body = pc.replace_substring(body, "\n", "\0\n\0")
        else:
            body = pc.replace_substring(body, " ", "\0")
            body = pc.replace_substring(body, "\n", "\0")
        if fine:
            body = pc.replace_substring(pc.replace_substring(body, ".", "\0."), ",", "\0,")
        lists = pc.split_pattern(body, "\0")
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        bad = np.zeros(len(index) + 1, bool)
        if byte:
            # White space beside white space or at an end of the text; special tokens.
            odd = pc.is_in(words, pa.array(["", " "], words.type)) if fine else pc.match_substring_regex(words, r"^ ?$|^ [^!-~\x{A1}-\x{1FFF}]|[^!-~\x{A1}-\x{1FFF}]$")
            if fine:
                odd = pc.or_(odd, pc.match_substring_regex(words, r"^ ?[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$"))
            for name in self.special:
                odd = pc.or_(odd, pc.match_substring(words, name))
            bad[:-1] = odd.to_numpy(zero_copy_only=False)[index]
            # The first piece of a text may be empty in an empty text only, and may be any word.
        if fine:
            mark = pc.or_(pc.starts_with(words, "."), pc.starts_with(words, ",")).to_numpy(zero_copy_only=False)[index]
            sure = pc.match_substring_regex(words, BEFORE_MARK)
            if not byte:
                sure = pc.or_(sure, pc.equal(words, ""))
            sure = sure.to_numpy(zero_copy_only=False)[index]
            follows = np.ones(len(index), bool)
            follows[ends[:-1][ends[:-1] < len(index)]] = False
            bad[:-1][1:] |= mark[1:] & follows[1:] & ~sure[:-1]
        found = self._ids(words.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(sizes) - sizes
        counts = sizes[index]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.uint32)
        for lo in range(0, len(index), GATHER):
            hi = min(lo + GATHER, len(index))
            jump = starts[index[lo:hi]] - (bounds[lo:hi] - bounds[lo])
            out[bounds[lo] : bounds[hi]] = pool[np.repeat(jump, counts[lo:hi]) + np.arange(bounds[hi] - bounds[lo])]
        seen = np.concatenate([[0], np.cumsum(bad[:-1])])
        return [out[bounds[a] : bounds[b]] for a, b in zip(ends[:-1], ends[1:])], seen[ends[1:]] > seen[ends[:-1]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids for each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        made: list = [np.empty(0, np.uint32)] * len(texts)
        left = np.flatnonzero(pc.not_equal(texts, "").to_numpy(zero_copy_only=False))
        if self.kind != "whole":
            zero = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
            whole, left = left[zero[left]], left[~zero[left]]
            for fine in (True, False):
                if len(left):
                    some, coarser = self._cut(texts.take(pa.array(left)), fine)
                    for k, ids, again in zip(left.tolist(), some, coarser.tolist()):
                        if not again:
                            made[k] = ids
                    left = left[coarser]
            left = np.concatenate([whole, left])
        for k in left.tolist():
            made[k] = self._whole(texts[k].as_py())
        pa.default_memory_pool().release_unused()  # several workers share an executor's memory
        return made


_ENCODERS: dict[tuple[int, bool], PieceEncoder] = {}


def piece_encoder(description: str, special: bool = True) -> PieceEncoder:
    """The worker's encoder, kept from task to task."""
    key = (zlib.crc32(description.encode()), special)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(description, special)
    return _ENCODERS[key]


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(lo, hi - lo)
