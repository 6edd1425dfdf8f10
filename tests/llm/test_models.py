"""Classifiers against brute-force versions, held-out rows and odd tables."""

import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from almenara.llm import language, quality, queries, toxicity
from almenara.llm.arrays import Hasher, pieces, runs
from almenara.llm.sampling import labelled_sample

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
ODD = [(1, None, "a"), (2, "", "b"), (3, "   \n\t ", "c"), (4, "word", "d"), (4, "word", "d"), (None, "x", None), (5, "ÉCOLE ÉTÉ 123 !!", "e"), (6, "1234 --- 5", "f"), (7, "long words here " * 20_000, "g")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def test_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abc xabc abcd abc", np.uint8)
    starts, ends, _ = runs(data != 32, np.array([0, len(data)]))
    a, b, c, d = Hasher(data)(starts, ends)
    assert a == d and len({int(a), int(b), int(c)}) == 3


def test_pieces_keep_whole_texts():
    texts = ["a" * 10, None, "", "b" * 50, "c"]
    out = [(lo, hi, bytes(data)) for lo, hi, data, _ in pieces(pa.array(texts), 20)]
    assert [x[0] for x in out] == [0, *[x[1] for x in out[:-1]]] and out[-1][1] == 5
    assert b"".join(x[2] for x in out) == b"a" * 10 + b"b" * 50 + b"c"


def test_runs_stop_at_text_borders():
    data = np.frombuffer(b"abcd", np.uint8)
    starts, ends, doc = runs(np.ones(4, bool), np.array([0, 2, 2, 4]))
    assert starts.tolist() == [0, 2] and ends.tolist() == [2, 4] and doc.tolist() == [0, 2] and len(data) == 4


def naive_ftrl(sets, labels, rates, epochs):
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << quality.BITS else rates.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -math.copysign(abs(z[i]) - l1, z[i]) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(epochs):
        for own, y in zip(sets, labels):
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rates.alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_follows_the_update_rule():
    texts = ["good text here", "bad!! BAD!! BAD!!", "more good words", "BAD!! noise!!", ""]
    labels = np.array([1.0, 0, 1, 0, 1])
    rates = quality.Rates(l1=0.1, epochs=30)
    got = quality.train(pa.array(texts), labels, rates)
    sets = []
    for _, hi, data, at in pieces(pa.array(texts)):
        doc, feature = quality.features(data, at)
        sets = [[*np.unique(feature[doc == k]).tolist(), 1 << quality.BITS] for k in range(hi)]
    want = naive_ftrl(sets, labels, rates, 30)
    assert np.allclose([got[i] for i in want], list(want.values()))
    assert set(np.flatnonzero(got)) <= set(want)
    margins = quality.margins(got.astype(np.float32), pa.array(texts))
    assert np.allclose(margins, [sum(want[i] for i in s) for s in sets], atol=1e-4)


@needs_tables
@pytest.mark.parametrize("name, label, least", [("op2_quality_classifier", "quality", 0.97), ("op8_toxicity_segments", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.QUERIES[name](spark, FOLDER).join(queries.table(spark, FOLDER, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 1), (None, 0), (6, 0), (7, None), (5, 3)], "doc_id long, label int")
    got = quality.score(odd, quality.fit(odd, labels))
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1


def test_models_of_empty_tables(spark, odd):
    nothing = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, nothing)).collect()} == {0.5}
    assert all(not r["passages"] for r in toxicity.score(odd, toxicity.fit(odd, nothing)).collect())
    model = language.fit(odd.limit(0).select("doc_id", "text", odd["score"].alias("lang")))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()} == {("und", 0.0)}
    empty = odd.limit(0)
    assert quality.score(empty, quality.fit(empty, nothing)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, nothing)).count() == 0
    assert language.predict(empty, model).count() == 0


def maximal(scores):
    """Maximal-scoring segments by their recursive definition: the best shortest segment, then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and (j - i) < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, _ = best
    return maximal(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in maximal(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(60):
        scores = np.round(rng.normal(-0.3, 2, rng.integers(0, 14)), 3)
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == [(a, b) for a, b, _ in maximal(scores.tolist())]


def test_toxic_passages_are_found_where_they_stand(spark):
    clean = [f"calm words about gardens and rivers number{i} in the valley" for i in range(300)]
    toxic = [f"calm words then vileword hateful{'abcdefgh'[i % 8]} about rivers number{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(420)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, "é calm vileword hatefulz rivers"), (2, "calm rivers in the valley"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(new, model).collect()}
    assert got[1]["score"] >= 0.7 and max(got[k]["score"] for k in (2, 3, 4)) < 0.5
    p = got[1]["passages"][0]
    assert "é calm vileword hatefulz rivers".encode()[p["first_byte"]:p["end_byte"]] == b"vileword hatefulz"


def code_length(text, trained):
    """Bits of a text after counting the contexts of the trained texts, by the plain rule."""
    counts = {}
    for t in trained:
        b = b"\n" * language.ORDER + t.encode()
        for i in range(language.ORDER, len(b)):
            for k in range(language.ORDER + 1):
                counts.setdefault(b[i - k:i], {}).setdefault(b[i], 0)
                counts[b[i - k:i]][b[i]] += 1
    bits, b = 0.0, b"\n" * language.ORDER + text.encode()
    for i in range(language.ORDER, len(b)):
        for k in range(language.ORDER, -1, -1):
            seen = counts.get(b[i - k:i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / (total + kinds))
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    trained = {"aa": ["the cat sat on the mat", "the end"], "bb": ["le chat est là", "été"]}
    names = sorted(trained)
    texts = pa.array([t for n in names for t in trained[n]])
    number = np.array([k for k, n in enumerate(names) for _ in trained[n]])
    model = language.build(language.count_grams(texts, number), names)
    probes = ["the mat", "chat là ça", "", "zzz", None]
    got = language.code_lengths(model, pa.array(probes))
    want = [[code_length(p or "", trained[n]) for n in names] for p in probes]
    assert np.allclose(got, want, rtol=1e-5)


@needs_tables
def test_language_of_held_out_texts(spark):
    rows = queries.QUERIES["op10_language_ppm"](spark, FOLDER).join(queries.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97


def test_language_of_odd_rows(spark, odd):
    model = language.fit(spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat est", "fr"), (3, "x", None), (4, None, "fr")], "doc_id long, text string, lang string"))
    got = language.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 6)] == ["und"] * 4
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "fr", "und"} and got.count() == len(ODD)


def test_sample_bound_holds_where_ids_repeat(spark):
    documents = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, "one text") for k in range(2, 40)] + [(5, "five")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, label int")
    kept, _ = labelled_sample(documents, labels, 1000, "doc_id", "text", "label")
    rows = kept.collect()
    assert len(rows) <= 39 and len({(r["h"], r["label"]) for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, labelled_sample(documents.repartition(5), labels, 1000, "doc_id", "text", "label")[0].collect()))


def test_hundreds_of_language_values(spark):
    rows = [(k, f"word{k % 400} text of language {k % 400}", f"l{k % 400}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.languages) == 400
    assert language.predict(df, model).filter("lang = lang_pred").count() > 700
