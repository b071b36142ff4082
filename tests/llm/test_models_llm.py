"""Trained filters, the SentencePiece codec, the licence scan and the pipeline."""

import os
import struct
import zlib

import numpy as np
import pytest

from coverset.llm import langid, licenses, quality, queries, sentencepiece, toxicity
from coverset.llm.common import fit_logistic, logistic

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def outside(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    p = logistic(fit_logistic(x, y), x)
    assert abs(p.mean() - y.mean()) < 0.01 and ((p > 0.5) == y).mean() > 0.78
    fit_logistic(x, (x[:, 0] > 0).astype(float))  # separable classes end too


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(2)
    common = [f"word{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(400):
        w = [str(x) for x in rng.choice(common, 60)]
        bad = i % 4 == 0
        if bad:
            for k in rng.choice(60, 3, replace=False):
                w[k] = str(rng.choice(["nasty", "vile"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_finds_its_class(spark, toxic_rows):
    rows, marks = toxic_rows
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].held_out == outside(i) for i in got)
    assert all(got[i].predicted == bad == int(got[i].score >= 0.7) for i, _, bad in marks)
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _, bad in marks if not bad}


def test_toxicity_learns_from_no_held_out_row(spark, toxic_rows):
    rows, marks = toxic_rows
    docs = spark.createDataFrame(rows, DOC)
    flipped = spark.createDataFrame([(i, q, 1 - t if outside(i) else t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    one, two = toxicity.train(docs, plain), toxicity.train(docs, flipped)
    assert len(one.words) and one.words.tolist() == two.words.tolist() and one.ratios.tolist() == two.ratios.tolist()
    assert np.allclose(one.calibration[2], two.calibration[2])


def test_toxicity_model_beyond_a_broadcast(spark, toxic_rows):
    rows, marks = toxic_rows
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "", None, None, 0), (3, rows[3][1], "en", "s", 1)], DOC)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    small, large = toxicity.train(docs, labels), toxicity.train(docs, labels, model_bytes=0)
    assert small.table is None and large.table.count() == len(small.words) > 0
    one, two = (sorted((r.doc_id, r.held_out, r.predicted, round(r.score, 9)) for r in toxicity.score(docs, m).collect()) for m in (small, large))
    assert one == two and len(one) == docs.count()


def test_toxicity_of_rare_forms(spark):
    rng = np.random.default_rng(8)
    name = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    common, rows, marks = [name(6) for _ in range(300)], [], []
    for i in range(600):
        w = [str(x) for x in rng.choice(common, 80)]
        bad = i % 4 == 0
        for k in rng.choice(80, 4, replace=False):  # forms that stand in one text only
            w[k] = ("zquorv" if bad else name(6)) + name(5)
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for size in (toxicity.MODEL_BYTES, 0):
        got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels, model_bytes=size)).collect() if r.held_out}
        assert len(got) > 100 and all(got[i] == bad for i, _, bad in marks if i in got)


def test_toxicity_recall_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    got = [(lang[r.doc_id], marks[r.doc_id], r.predicted) for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in marks]
    recall = {x: np.mean([p for y, t, p in got if y == x and t]) for x in ("en", "de", "fr", "es")}
    print({x: f'{sum(p for y, t, p in got if y == x and t)}/{sum(t for y, t, _ in got if y == x)}' for x in recall}, sum(p for _, t, p in got if not t))
    assert min(recall.values()) >= 0.8 and np.mean([t for _, t, p in got if p]) >= 0.97


ODD = [(1, None, None, None, None), (2, "", "", "", 0), (None, "x y", None, "s", 1), (3, "!!! ...", "en", None, None), (3, "long " * 30_000, "en", "s", 5)]


def test_trained_operators_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in ODD], DOC + ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0] * 5
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [1.0] * 5
    assert toxicity.reject(docs, none).count() == quality.reject(docs, none).count() == 5
    marks = spark.createDataFrame([(2, 0, 0), (3, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for op in (toxicity, quality):
        for rows in (docs, docs.limit(0)):
            scores = [r.score for r in op.score(rows, op.train(rows, marks)).collect()]
            assert all(0 <= s <= 1 for s in scores) and len(scores) == rows.count()
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert quality.score(docs.select("doc_id", "text"), None).count() == 5


def test_held_out_toxicity_and_quality(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = [r for r in queries.op2_toxicity(spark, sf).collect() if r.doc_id in marks and r.held_out]
    hit = [marks[r.doc_id].toxic for r in toxic if r.predicted]
    assert len(hit) >= 10 and sum(hit) / len(hit) >= 0.9
    good = [r for r in queries.op9_quality(spark, sf).collect() if r.doc_id in marks and r.held_out]
    assert sum(marks[r.doc_id].quality == r.accepted for r in good) / len(good) > 0.97


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op6_language(spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_gradient_is_the_slope():
    net = langid.Network(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(60, 70, (7, 4)).astype(np.int16)
    x[5:, 0] = langid.PAD
    y = np.array([0, 1, 2, 0])
    grad, loss = net.gradient(x, y)
    for name, index in (("e", (0, int(x[2, 1]), 3)), ("e", (1, int(x[3, 2]), 12)), ("uf", (1, 2, 3)), ("uc", (0, 1, 5)), ("w", (4, 1)), ("b", (2,))):
        keep, step = net.p[name][index], 1e-2
        net.p[name][index] = keep + step
        up = net.gradient(x, y)[1]
        net.p[name][index] = keep - step
        down = net.gradient(x, y)[1]
        net.p[name][index] = keep
        assert abs((up - down) / (2 * step) - grad[name][index]) < 2e-4


def test_language_reads_whole_texts():
    texts = [b"ab" * 40_000, b"", b"xyz"]
    seen = [0] * 3
    for who, x in langid._cut(texts):
        for k, column in zip(who.tolist(), x.T):
            seen[k] += int((column != langid.PAD).sum())
    assert seen == [len(t) for t in texts]
    net = langid.Network(["a", "b"])
    assert np.allclose(net.pool(texts).sum(axis=1), [1, 0, 1], atol=1e-4)


def test_language_odd_rows(spark):
    net = langid.Network(["a", "b"])
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é"), (None, "word")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.predict(docs, net).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and got[4][0] in "ab" and got[None][0] in "ab"
    assert all(got[k][1] == outside(k) for k in (1, 2, 3, 4)) and got[None][1] is False


TEXTS = ["", " ", "a", "two  spaces   three", " lead", "trail ", "line\nbreak\ttab", "日本語 und ÄÖ ß 🙂", "▁ marker ▁▁x", "x" * 3000, "Hello, world! don't", "<s> </s> <unk> <0x41>", "á combining é"]


def test_codec_parity_on_whole_texts(spark):
    import sentencepiece as original

    sp = original.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        codec = sentencepiece.Codec(file.read())
    assert codec.cuts and codec.model.kind == sentencepiece.BPE and codec.model.byte_fallback
    texts = TEXTS[:8] + TEXTS[9:] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    made = codec.encode(texts)
    assert [ids.tolist() for ids, _ in made] == sp.encode(texts) and all(ok for _, ok in made)
    assert [codec.decode(ids) for ids, _ in made] == [sp.decode(x) for x in sp.encode(texts)] == texts


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    """A protobuf message from (number, value) pairs: int, float or bytes."""
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_models(fallback):
    import sentencepiece as original

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁ab", -6.0, 1), ("c", -4.2, 1), ("bc", -5.1, 1), ("abc", -9.5, 1)]
    raw = message(
        *[(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces],
        (2, message((3, 1), (35, fallback), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))),
    )
    sp = original.SentencePieceProcessor(model_proto=raw)
    codec = sentencepiece.Codec(raw)
    texts = ["abc ab", "  a   bc  ", "abcabc", "a?b", "", "cab cab é"]
    made = codec.encode(texts)
    assert [ids.tolist() for ids, _ in made] == sp.encode(texts) and all(ok for _, ok in made)


def test_encode_and_decode_tables(spark):
    rows = [(k, t, 7) for k, t in enumerate([None, *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    made = sentencepiece.encode(docs, MODEL)
    assert made.columns == ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip", "parity"]
    got = {r.doc_id: r for r in made.collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].ids == []
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got.values())
    assert all(got[k].round_trip and got[k].parity for k in got if "▁" not in (rows[k][1] or ""))
    back = {r.doc_id: r.text for r in sentencepiece.decode(made, MODEL).collect()}
    assert all(back[k] == (t or "") for k, t, _ in rows if "▁" not in (t or ""))
    assert sentencepiece.encode(docs.limit(0), MODEL).count() == 0


def test_licences(spark):
    mit = dict((name, text) for name, text in licenses.KNOWN[:1])["MIT"]
    loud = "Copyright (c) 2020 Someone\n\n  All rights reserved.\n" + mit.upper().replace("SUBLICENSE", "sub-licence") + "\n"
    rows = [
        (1, mit, "x"), (2, loud, "x"), (3, mit + " And more.", "x"), (4, None, "x"), (5, "", "x"), (6, "...", "x"), (7, "text\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.", "x"),
        (7, "SPDX-License-Identifier: Apache-2.0", "x"), (None, mit, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    want = [(None, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, None), (7, "Apache-2.0")]
    for known in (None, licenses.known_table(spark)):
        got = licenses.scan(docs, known).collect()
        assert sorted(((r.doc_id, r.license_id) for r in got), key=str) == sorted(want, key=str)
        assert {r.notices for r in got if r.doc_id == 7} == {"CC-BY-NC-4.0,MIT", "Apache-2.0"}
        assert {r.digest for r in got if r.doc_id in (4, 5, 6)} == {None}
    assert len({r.digest for r in licenses.scan(docs).collect() if r.doc_id in (1, 2)}) == 1
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, licenses.known_table(spark).limit(0)).filter("license_id IS NOT NULL").count() == 0


def test_licences_at_any_width():
    import textwrap

    head = "Copyright (c) 2020 Someone\n(C) Copyright Jane Doe\nAll rights reserved.\n\n"
    for _, text in licenses.KNOWN:
        want = licenses.digest(text)
        for width in (20, 40, 60, 66, 70, 72, 76, 78, 79, 80, 100):
            wrapped = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))
            assert {licenses.digest(wrapped), licenses.digest(head + wrapped), licenses.digest(wrapped.upper())} == {want}
    isc = "provided that the above\ncopyright notice and this permission notice appear in all copies."
    assert "copyright notice and this" in licenses.canonical(isc)
    assert licenses.digest("(c) You must retain it") != licenses.digest("(c) You may drop it")
    assert licenses.digest("Copyright Jane Doe\n© 2019, 2020 Firm\n(c) 2001 Firm") is None


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright
       notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_NAME = """    3. Neither the name of the copyright holder nor the names of its contributors
       may be used to endorse or promote products derived from this software
       without specific prior written permission.
"""


def test_whole_licence_texts(spark):
    rows = [(1, "Copyright (c) 2001 Firm\n" + BSD % "", "BSD-2-Clause"), (2, BSD % BSD_NAME, "BSD-3-Clause"), (3, BSD % "4. More.\n", None)]
    shipped = "/usr/share/common-licenses"  # where the system has them
    for k, (name, want) in enumerate((("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"))):
        if os.path.exists(f"{shipped}/{name}"):
            with open(f"{shipped}/{name}", encoding="utf-8") as file:
                rows.append((10 + k, file.read(), want))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {k: want for k, _, want in rows}
    assert len({d for _, d in licenses.WHOLE}) == len(licenses.WHOLE)


def test_licence_join_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "fits_broadcast", lambda *a: False)
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "none")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs).collect() if r.license_id) == [(1, "MIT", "MIT")]
    assert licenses.scan(docs).count() == 2


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, marks = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.persist()
            rows = docs.collect()
            assert all(before[r.doc_id] == r for r in rows) and len(rows) > len(before) / 2
            before = {r.doc_id: r for r in rows}
            if name == "quality":  # a few dozen labels to learn from
                assert 2 * sum(marks[d].quality == 0 for d in before if d in marks) < sum(m.quality == 0 for m in marks.values())
    out = docs.collect()
    assert len(out) == len(before) and all(r.parity and r.round_trip for r in out)


def test_pipeline_survives_empty_tables(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame(ODD, DOC)
    for rows, count in ((odd, 5), (odd.limit(0), 0)):
        docs = rows
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() <= count


def test_views_of_quality_are_separate_and_every_row_may_teach(spark):
    """The page view sees no text; an unlabelled row anywhere in the table can become a lesson."""
    a, b = quality.page_view("s", "en", 5), quality.page_view("s", "en", None)
    assert a.shape == b.shape and not np.array_equal(a, b)
    assert quality.content_view("").shape == quality.content_view("Some text.\nMore").shape
    rng = np.random.default_rng(4)
    content, page = rng.normal(size=(400, 6)), rng.normal(size=(400, 3))
    y = (content[:, 0] > 0).astype(int)  # the page view knows nothing
    state = quality.CoTraining(content[:200], page[:200], y[:200], np.arange(200) % 4 == 0)
    teachers = state.teachers()
    sure = []
    for v, x in enumerate((content, page)):
        model, calibration = teachers[v]
        raw = np.clip(quality.logistic(model, x[200:]), 1e-6, 1 - 1e-6)
        p = quality.logistic(calibration, np.log(raw / (1 - raw))[:, None])
        sure.append(int((np.maximum(p, 1 - p) >= quality.CONFIDENT).sum()))
    assert sure[0] > 20 and sure[1] == 0
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(200)), pa.array(range(200)), pa.array(content[200:].tolist(), pa.list_(pa.float32())), pa.array(page[200:].tolist(), pa.list_(pa.float32()))],
        names=["row", "tie", "content", "page"],
    )
    run = quality._surest(teachers, [set(), {3, 5}], (4, 7))
    parts = [run(iter([batch.slice(k, 50)])) for k in range(0, 200, 50)]
    rows = [r for part in parts for made in part for r in made.to_pylist()]
    assert {r["teacher"] for r in rows} == {0} and not {3, 5} & {r["row"] for r in rows}
    for mark, each in ((0, 4), (1, 7)):
        mine = sorted((r["sure"] for r in rows if r["mark"] == mark), reverse=True)
        whole = [r["sure"] for made in run(iter([batch])) for r in made.to_pylist() if r["mark"] == mark]
        assert len(whole) == each and mine[:each] == sorted(whole, reverse=True)
