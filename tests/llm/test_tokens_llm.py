"""Pieces against whole-text encoding; token files with repeated and null ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from coverset.llm import tokenbin
from coverset.llm.pieces import PieceEncoder

TEXTS = [
    "", None, " ", "  a  b ", "a\n\nb c", "it's Bob's. don't", "x <|endoftext|> y", "x<|endoftext|>y", "é́ à b́c", "a b c d", "ǅ Σας ΟΔΟΣ", "12ab 3.4,5",
    "a\n b", "a \nb", "\ta b\t", "日本語 テキスト", "a'sb c'll", "x\r\ny z", "foo.\n\nBar baz", "İ. İstanbul I", "<|startoftext|>a b", "ß ẞ ÄÖ", "a\x1cb c \x1c d",
    "a_b __c #d", "\0a b\0", "​ a", "ÀÉ à. b", "a. b", "a.  b", "''s 's", "... a.. b.,c", "word " * 3000, "Ünï,straße.Ok " * 500,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special", [True, False])
def test_pieces_are_whole_texts(name, special):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = not special
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        mine = PieceEncoder(file.read(), special)
    assert mine.kind == name.split("_")[0]
    rng = random.Random(3)
    letters = [*"aB.\n 'é,1ś<|İΣ́", "ll", "  ", "<|endoftext|>", "that", "...", "\n\n"]
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(4000)]
    for _ in range(2):  # the second time from memory
        got = mine.encode(pa.array(texts, pa.string()))
        for text, ids in zip(texts, got):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_repeated_and_null_ids(spark):
    rows = [(5, "one two"), (5, "one two"), (5, "three"), (None, "no id"), (None, None), (1, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = tokenbin.read(tokenbin.write(docs, public_tokenizers.path("byte_bpe_50k.json"), tokenbin.new_folder(spark), file_rows=2)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda text: zlib.crc32(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids_crc32) for r in made), key=key) == sorted(((d, crc(t)) for d, t in rows), key=key)
    ends, at = sorted((r.start, r.n_tokens, r.doc_id) for r in made), 0
    for start, n, _ in ends:
        assert start == at
        at += n
    assert [d for _, _, d in ends] == [None, None, 1, 5, 5, 5]
