"""Mixture packing, prefix trie and resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coverset.llm import mixture, queries, resample, trie
from coverset.llm.common import words

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_rounds_are_the_order_of_due_times():
    rng = np.random.default_rng(0)
    for t in range(60):
        k, size = int(rng.integers(1, 7)), int(rng.integers(3, 40))
        lengths = rng.integers(1, 300, k)
        weights = lengths / lengths.max() if t % 2 else rng.random(k) + 0.01
        plan = mixture.Rounds(weights, lengths, size)
        sent = plan.sent(np.arange(plan.windows + 1))
        assert (sent.sum(1) == np.minimum(np.arange(plan.windows + 1) * size, lengths.sum())).all() and (np.diff(sent, axis=0) >= 0).all()
        due = sorted(((j + 0.5) / weights[q], q) for q in range(k) for j in range(lengths[q]))
        now, plain = np.zeros(k, int), [np.zeros(k, int)]
        for i, (_, q) in enumerate(due, 1):
            now[q] += 1
            if i % size == 0 or i == len(due):
                plain.append(now.copy())
        assert abs(np.array(plain) - sent).max() <= 1
        for q in range(k):
            places = np.arange(lengths[q])
            window = plan.window_of(q, places)
            assert (sent[window, q] <= places).all() and (sent[window + 1, q] > places).all()
    # The deficits at any window far on are found without those before.
    lengths = np.array([5 * 10**12, 3 * 10**12, 10**9, 7])
    plan = mixture.Rounds(lengths / lengths.max(), lengths, 4096)
    late = np.arange(plan.windows - 500, plan.windows + 1)
    sent = plan.sent(late)
    ideal = np.minimum(late * 4096, plan.total)[:, None] * (lengths / plan.total)
    assert (sent[-1] == lengths).all() and abs(sent - ideal).max() <= 2


def check_pieces(rows, docs, size, end_id):
    """Every id of every document once, windows full but the last, offsets gapless; returns the windows' tokens by source."""
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text, source in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        want[doc, source or "", tuple(ids)] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.source, r.doc_tokens].append(r)
    found = Counter()
    for (doc, source, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: (r.start, r.sequence_id))
        copies = sum(c for (d, s, ids), c in want.items() if d == doc and s == source and len(ids) == n)
        assert sum(r.length for r in pieces) == copies * n
        if copies == 1:
            (ids,) = [i for d, s, i in want if d == doc and s == source and len(i) == n]
            at = 0
            for r in pieces:
                assert r.start == at and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
        found[doc, source, n] += copies
    assert sum(found.values()) == len(docs)
    windows, mix = defaultdict(list), defaultdict(Counter)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        mix[r.sequence_id][r.source] += r.length
    assert sorted(windows) == list(range(len(windows)))
    for w, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or w == len(windows) - 1 and at < size
    return [mix[w] for w in range(len(windows))]


def test_op11_on_a_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op11_packing(spark, SF).collect()
    mix = check_pieces(rows, docs, 4096, 2)
    total = sum(mix, Counter())
    for window in mix[:-1]:  # every source has its share of every window
        for source, n in total.items():
            if n * 4096 >= mixture.LEAST_TOKENS * sum(total.values()):
                assert abs(window[source] - 4096 * n / sum(total.values())) <= 3


def test_packing_by_targets_and_odd_rows(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(n))
    docs = [(k, say(rng.randint(0, 60)), rng.choice(["a", "b", "c"])) for k in range(150)]
    docs += [(500, None, "a"), (501, "", None), (None, say(5), "b"), (7, say(3), "z"), (600, say(900), "a"), (601, say(4), "rare")]
    table = spark.createDataFrame([(d, t, s, 0, "x") for d, t, s in docs], "doc_id long, text string, source string, offset int, part string").repartition(5)
    rows = mixture.pack(table, WORDS, size=64, targets={"a": 3.0, "b": 1.0, "c": 1.0}, with_ids=True).collect()
    mix = check_pieces(rows, docs, 64, 2)
    left = Counter()
    for window in mix:
        left.update(window)
    for window in mix[: len(mix) // 3]:
        shares = window["a"] + window["b"] + window["c"]
        assert abs(window["a"] - 0.6 * shares) <= 2 and abs(window["b"] - 0.2 * shares) <= 2
    made = {r.sequence_id: bytes(r.ids) for r in mixture.sequences(mixture.pack(table, WORDS, size=64, with_ids=True)).collect()}
    assert {len(v) for k, v in made.items() if k < len(made) - 1} == {256}
    # A source of few tokens with a target of its own is sent token by token, over many windows.
    thin = mixture.pack(table, WORDS, size=64, targets={"rare": 0.02, "a": 1.0}, max_queues=2).collect()
    check_pieces(thin, docs, 64, 2)
    assert mixture.pack(table.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError):
        mixture.pack(table, WORDS, targets={"a": 0.0})


def plain_trie(rows, block=100, most=5):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, mark, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        whole[c] = turns.get(c - int(math.fmod(c, block)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for key, who in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(key))))
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), kids[key], sum(not kids[k] for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("unit_rows", [None, 6])
def test_trie_is_plain(spark, unit_rows):
    rng = random.Random(6)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), 205, -3, -100, 1_000_000_007]:
        n = rng.choice([1, 2, 2, 3, 4, 8])
        rows += [(conv, k, "user" if k % 2 == 0 else "bot", rng.choice(["hi", "héllo", "what is it"]) if k < 2 else rng.choice(["a", "b", None, ""])) for k in range(n)]
    rows += [(300 + k, 0, "user", "one common turn") for k in range(40)] + [(350 + k, j, "user", "same") for k in range(12) for j in range(3)]
    rows += [(400, k, "user", f"long {k}") for k in range(50)] + [(401, k, "user", f"long {k}") for k in range(50)]  # long conversations
    rows += [(500, None, None, None), (500, None, None, None), (500, 1, "b", "x"), (500, 1, "a", "y"), (500, 1, "a", "x"), (None, 1, "user", "lost")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        table = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(4)
        got = trie.prefix_trie(table, unit_rows=unit_rows).select(TRIE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == plain_trie(rows)
    if unit_rows is None:
        assert trie.prefix_trie(table.limit(0)).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2)).astype(np.uint64), axis=0)
        slots = trie.Slots(keys)
        assert sorted(slots.find(keys).tolist()) == list(range(len(keys)))
        assert (slots.find(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.zeros((2, 2), np.uint64))


def test_ends_of_a_hot_node(spark):
    ids = random.Random(1).sample(range(10**6), 9000)
    rows = [(bytearray(b"a" * 16), i) for i in ids] + [(bytearray(b"b" * 16), 5)]
    got = {bytes(r.digest): r.ends_sha256 for r in trie.ends_of(spark.createDataFrame(rows, "digest binary, conv_id long")).collect()}
    assert got == {b"a" * 16: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"b" * 16: hashlib.sha256(b"5").hexdigest()}


def test_planes_give_exact_sums():
    rng = np.random.default_rng(3)
    for buckets in (1, 63, 64, 1000):
        counts = rng.integers(0, 4, (9, buckets)) * rng.integers(0, 2, (9, buckets))
        counts[0, 0] = 123_456
        gain = rng.integers(-15_000, 15_000, buckets)
        assert (resample.weigh(counts, resample.signed_planes(gain)) == counts @ gain).all()
    assert (resample.weigh(np.zeros((2, 5), int), resample.signed_planes(np.zeros(5, int))) == 0).all()


def plain_resample(docs, items, longest, percent=10, least=20, m=10_000, seed=2024):
    feats = lambda t: resample.features(t, longest)
    count = lambda texts: Counter(zlib.crc32(f) % m for t in texts for f in feats(t))
    s, t = count(x for _, x in docs), count(items)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m))))
    rows = []
    for doc, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % m) for f in feats(text))
        rows.append([doc, len(feats(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_is_plain(spark, longest):
    rng = random.Random(4)
    pool = ["alpha", "Beta", "é1", "x2", "日本", "the"]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for k in range(120)]
    docs += [(None, "the " * 30), (200, None), (201, ""), (5, "the " * 25), (5, "the " * 25), (202, "rare " * 3000)]
    items = ["the the x2 alpha", None, "", "Beta x2"]
    table = spark.createDataFrame([(d, t, 9, 0.5) for d, t in docs], "doc_id long, text string, weight int, score double").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in items], "text string, doc_id int")
    got = resample.resample(table, target, percent=30, longest=longest)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, items, longest, 30)
    if longest == 1:
        assert resample.resample(table.limit(0), target).collect() == []
        alone = resample.resample(table, target.limit(0), percent=30)
        assert sorted(map(tuple, alone.collect()), key=str) == plain_resample(docs, [], 1, 30)
