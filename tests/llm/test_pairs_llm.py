"""SimHash and vector near-duplicates against brute force."""

import os

import numpy as np
import pytest
import xxhash

from coverset.llm import embeddings, queries, simhash
from coverset.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op1_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: plain_fingerprint(r.text, 4) for r in rows}
    ids = sorted(fp)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 4]
    root = roots(len(ids), pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", ids[root[k]]) for k, d in enumerate(ids)}


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_links_lose_nothing(spark, block_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = [int(b) for b in base]
    for b in base[:3]:
        fps += [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 4), replace=False)) for _ in range(20)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "node long, fp array<long>")
    got = simhash.links(nodes, simhash.pigeonhole(64, 4, 3), 4, block_rows).collect()
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 8 or True for r in got)
    assert roots(len(fps), [(r.a, r.b) for r in got]) == roots(len(fps), want)


def test_dense_group_is_searched(monkeypatch):
    monkeypatch.setattr(simhash, "MANY_PAIRS", 10)
    fps = np.array([[k] for k in range(64)], np.uint64)
    left, right = simhash.group_links(fps, fps[:, 0], simhash._ball(20, (0, 10), 1), 4)
    assert len(set(roots(64, list(zip(left.tolist(), right.tolist()))))) == 1 and len(left) < 64


def test_pigeonhole_covers():
    for bits, distance, segments in ((64, 4, 3), (64, 3, 2), (64, 6, 3)):
        layout = simhash.pigeonhole(bits, distance, segments)
        assert sum(w for _, w, _ in layout) == bits or max(w for _, w, _ in layout) == 32
        assert sum(r + 1 for _, _, r in layout) > distance


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, None, "x"), (4, "", "x"), (3, " \t\n", "x"), (9, long, "x"), (8, long + " tail", "x"), (7, "one two", "x"), (7, "one two", "x"), (None, "lone text here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    by = {(r.doc_id): r.component_id for r in got}
    assert len(got) == len(rows)
    assert by[5] == by[4] == by[3] == 3 and by[9] == by[8] == 8 and by[7] == 7 and by[None] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_id_joins_its_groups(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, "other words stand here alone today")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def plain_similar(texts, similarity=0.8, size=5):
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return roots(len(texts), pairs)


def changed_texts(seed, shares, each, words=200):
    """A fresh text and a copy with its tail replaced, ``each`` times for every Jaccard similarity in ``shares``."""
    rng, out = np.random.default_rng(seed), []
    for share in shares:
        keep = int(np.ceil((words - 4) * 2 * share / (1 + share))) + 4
        for _ in range(each):
            one = [f"w{k}" for k in rng.integers(0, 10**9, words)]
            out += [" ".join(one), " ".join(one[:keep] + [f"v{k}" for k in rng.integers(0, 10**9, words - keep)])]
    return out


def test_pairs_below_the_similarity_stay_apart(spark):
    texts = changed_texts(5, (0.6, 0.65, 0.7, 0.75, 0.79), 12)
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert plain_similar(texts) == list(range(len(texts)))
    assert all(r.component_id == r.doc_id for r in got)


def test_pairs_at_the_similarity_are_met(spark):
    texts = changed_texts(7, (0.8,), 500, 60)
    rows = list(enumerate(texts)) + [(2001, "one two three four five six seven eight"), (2002, "one two three four five six seven eight nine")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), planes=0).collect()}
    want = plain_similar([t for _, t in rows])
    assert [got[d] for d, _ in rows] == [rows[k][0] for k in want] and sum(k != i for i, k in enumerate(want)) == 501


def test_kept_documents_are_found_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [][0])
    texts = changed_texts(9, (0.8,), 500, 60) + changed_texts(10, (0.6, 0.7, 0.79), 20) + ["", "one two", "one  TWO"]
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k for k, root in enumerate(plain_similar(texts)) if k == root}
    assert want <= kept and len(kept - want) <= 5


def test_blocks_of_a_candidate_group_lose_no_link(spark):
    rng = np.random.default_rng(6)
    now, texts = [f"w{k}" for k in range(120)], []
    for step in range(30):  # a chain: only neighbours are similar
        texts.append(" ".join(now))
        now = now[5:] + [f"x{step}-{k}" for k in range(5)]
    rows = [(int(k), texts[k]) for k in rng.permutation(30)]
    docs = spark.createDataFrame([(xx, 0, t) for xx, t in rows], "node long, root long, text string")
    edges = simhash.verified(docs, docs.select("node", "root"), 5, 0.8, text_rows=4).collect()
    want = plain_similar(texts)
    assert roots(30, [(e.a, e.b) for e in edges]) == want and len(set(want)) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(50, 60), (60, 55), (70, 70), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 55: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good]).reshape(len(good), -1)
    sim = unit @ unit.T >= threshold if len(good) else np.zeros((0, 0), bool)
    pairs = [(i, j) for i in range(len(good)) for j in range(i) if sim[i, j]]
    root = roots(len(good), pairs)
    comp = {}
    for k in range(len(good)):
        comp[root[k]] = min(comp.get(root[k], good[k][0]), good[k][0])
    out = {i: (0, i, True) for i, _ in rows}
    for k, (i, _) in enumerate(good):
        out[i] = (int(sim[k].sum()) - 1, comp[root[k]], comp[root[k]] == i)
    return out


@pytest.mark.parametrize("block_rows", [4, 4096])
def test_vectors_are_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(30)]
    for c in range(3):
        center = rng.standard_normal(16)
        rows += [(100 * (c + 1) + i, (center + 0.05 * rng.standard_normal(16)).tolist()) for i in range(25)]
    rows += [(900, rows[40][1]), (901, rows[40][1]), (910, None), (911, []), (912, [0.0] * 16), (913, [float("nan")] * 16), (914, [float("inf")] + [1.0] * 15), (915, [None] + [1.0] * 15)]
    rows.reverse()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block_rows=block_rows).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_op3_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_embedding_dedup(spark, SF).collect()}
    assert got == brute_vectors(rows)
