"""Decontamination, shards and token files against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from coverset.llm import decontaminate, queries, sharding, tokenbin

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        if w:
            k = min(size, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if items_here := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= items_here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def judged(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_op5_is_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = judged(queries.op5_decontaminate(spark, SF))
    assert got == plain_scan(docs, items) and any(v[4] for v in got.values())


ITEMS = [(1, "Alpha beta, gamma!"), (10, " ".join(f"t{i}" for i in range(20))), (2, None), (3, "..."), (4, "été À la"), (5, "alpha beta gamma")]
DOCS = [(1, "x ALPHA--beta gamma y alpha beta"), (2, None), (3, ""), (4, "t3 t4 t5 t6 t7 t8 t9 t10 t11 t12 t13 t14 t15 t16 z " * 2), (5, "Été À la carte été À la"), (6, "w " * 30_000 + "alpha beta gamma")]


@pytest.mark.parametrize("set_bytes", [1, 10**6])
def test_scan_in_passes(spark, set_bytes):
    docs = spark.createDataFrame([(*d, 7) for d in DOCS], "doc_id long, text string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert judged(decontaminate.judge(decontaminate.scan(docs, items, set_bytes=set_bytes))) == plain_scan(DOCS, ITEMS)
    left = decontaminate.remove(docs, items, set_bytes=set_bytes)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 6]
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, items, mode="spans", set_bytes=set_bytes).collect()}
    assert cut[1] == "x  y alpha beta" and cut[5] == "Été À la carte " and cut[2] is None and cut[6] == DOCS[5][1]
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.judge(decontaminate.scan(docs, items.limit(0))).collect()} == {0}


def test_op8_law(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    n = len(got)
    back = sharding.permuted(spark.createDataFrame([(r.slot * 40 + r.shard, r.row_no) for r in got], "p long, row_no long"), "p", n, "found", back=True)
    assert back.filter("found <> row_no").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4099])
def test_permutation(spark, n):
    made = sharding.permuted(spark.range(n), "id", n, "place", seed=3)
    out = [r.place for r in made.orderBy("id").collect()]
    assert sorted(out) == list(range(n)) and (n < 100 or sum(a == b for a, b in enumerate(out)) < n / 10)
    assert sharding.permuted(made, "place", n, "again", seed=3, back=True).filter("again <> id").count() == 0


def test_shards_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, "é", "b"), (None, "", "c")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard string"), shards=3).collect()
    assert sorted(r.size for r in got) == [16, 16, 16, 18] and sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def expect(rows):
    start, out = 0, []
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op10_is_plain(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op10_token_binary(spark, SF).collect())) == expect(rows)


def test_token_files_odd_rows(spark):
    import public_tokenizers

    texts = [None, "", " ", "a  b", " lead and trail ", "tab\tnl \n x\n y", "don't we'll 'tis it's'", "nbsp here", "<|endoftext|> in text", "x1y2,z3... -- (a)b", "日本 語 é́ e", "\x1c a \x85b", "word " * 5000, "Ünïcôde,straße.Ok", "'s 's a's'b"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in reversed(rows)], "doc_id long, text string, start int")
    folder = tokenbin.new_folder(spark)
    manifest = tokenbin.write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, file_rows=4)
    assert manifest.count() > 1
    assert sorted(map(tuple, tokenbin.read(manifest).collect())) == expect(rows)
    empty = tokenbin.write(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), tokenbin.new_folder(spark))
    assert tokenbin.read(empty).count() == 0


def test_op10_is_the_unmodified_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = list(enumerate(["plain, text.", "end of page <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b  c <|endoftext|>\n", "<|endoftext", None, "last words"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op10_token_binary(spark, str(tmp_path)).collect())) == want and 50256 in t.encode(rows[1][1]).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_and_random_access(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 20_000).astype(np.uint32)
    assert (tokenbin.unpack(tokenbin.pack(ids, bits), len(ids), bits) == ids).all()
    out = tokenbin.Writer(f"file://{tmp_path}/x.bin", bits)
    cuts = [0, 5, 5, 9000, 20_000]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        out.add(k, ids[a:b])
    out.close()
    file = tokenbin.Reader(f"file://{tmp_path}/x.bin")
    assert [file.document(k).tolist() for k in range(4)] == [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    assert file.read(8190, 5).tolist() == ids[8190:8195].tolist()


def test_items_without_an_id_match_nothing(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), ("7", None), ("8", "")], "item_id string, text string")
    for set_bytes in (1, 10**6):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.judge(decontaminate.scan(docs, items, set_bytes=set_bytes)).collect()}
        assert got == {1: (20, 0, 0), 2: (0, 0, 0)}


def test_windows_are_verified_by_words():
    """Every hash the same: words decide."""
    held = decontaminate.Windows([("a", "one two three four"), ("b", "two three"), ("c", "")], 3)
    held.by_size = {w: (np.zeros_like(h), p, i) for w, (h, p, i) in held.by_size.items()}
    held._hash = lambda ids, at, width: np.zeros(len(at), np.uint64)
    assert held.scan(["zero one two three", "three two one", None, "two two three two three"]) == [
        (4, [(1, 4)], {"a", "b"}), (3, [], set()), (0, [], set()), (5, [(1, 5)], {"b"}),
    ]
