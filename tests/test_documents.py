"""Cleaning, the splitter and encoding."""

import hashlib
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as registry
from almenara.functions import text
from almenara.operators import documents as ops


def clean(spark, text):
    return ops.clean_pages(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")).first().clean


@pytest.mark.parametrize("raw, out", [
    ("34 NORMAS LEGALES Jueves 8 de enero de 2026  El Peruano /\nArticulo", "Articulo"),
    ("35NORMAS LEGALESJueves 8 de enero de 2026 El Peruano / Articulo", "Articulo"),
    ("contrata-\nción del  estado", "contratación del estado"),
    ("a\n\n\n\nb", "a\n\nb"), ("a \n b", "a\nb"), ("\n  12  \nTexto", "Texto"), ("Página 3 de 10 texto", "texto"),
    ("coope­rar \x07 ﬁn", "cooperar fin"), ("  \t ", ""),
])
def test_cleaning(spark, raw, out):
    assert clean(spark, raw) == out


def test_splitter_prefers_strong_separators():
    text = "Intro corta\nArtículo 1. " + "palabra " * 20 + "\nArtículo 2. " + "otra " * 20
    parts = ops.split_text(text, 200, 0)
    assert parts[0] == "Intro corta\nArtículo 1. " + ("palabra " * 20).strip()
    assert parts[1].startswith("Artículo 2.")


def test_splitter_overlap_repeats_the_tail():
    words = [f"w{i:02d}" for i in range(30)]
    parts = ops.split_text(" ".join(words), 40, 12)
    assert all(len(p) <= 40 for p in parts)
    for a, b in zip(parts, parts[1:]):
        assert b.split()[0] in a.split()[-4:]


def test_splitter_keeps_words_it_cannot_cut():
    assert ops.split_text("x" * 50, 20, 5) == ["x" * 50]
    assert ops.split_text("", 20, 5) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 60))
def test_splitter_loses_nothing(text, size):
    parts = ops.split_text(text, size, 0)
    assert "".join("".join(p.split()) for p in parts) == "".join(text.split())
    assert all(p in text for p in parts)


def test_fragments_never_cross_a_page_and_short_ones_go(spark):
    pages = spark.createDataFrame([("d", 1, "uno " * 100), ("d", 2, "corto"), ("d", 3, "tres " * 100)], "doc string, page int, text string")
    out = ops.chunk_pages(pages, 120, 30).collect()
    assert {r.page for r in out} == {1, 3}
    assert all(len(r.text) >= 40 and set(r.text.split()) <= {{1: "uno", 3: "tres"}[r.page]} for r in out)
    assert len({r.id for r in out}) == len(out)


def test_own_sizes_per_page(spark):
    pages = spark.createDataFrame([("d", 1, "uno " * 200, 100, 0), ("d", 2, "uno " * 200, 400, 0)], "doc string, page int, text string, size int, overlap int")
    n = {r.page: r["n"] for r in ops.chunk_pages(pages).groupBy("page").agg(F.count("*").alias("n")).collect()}
    assert n[1] > 3 * n[2]


def test_vectors_have_unit_length_and_prefixes_differ(spark):
    df = spark.createDataFrame([("una norma",), ("",)], "text string")
    p = [np.array(r.embedding) for r in ops.encode_passages(df).collect()]
    q = [np.array(r.embedding) for r in ops.encode_queries(df).collect()]
    assert [np.linalg.norm(v) for v in p + q] == pytest.approx([1, 1, 1, 1], abs=1e-6)
    assert not np.allclose(p[0], q[0])


def test_encoder_can_be_replaced(spark):
    def make():
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([("abc",)], "text string")
    assert ops.encode(df, "text", make, prefix="").first().embedding == [1.0, 0.0]


def test_hashed_vectors_are_signed_word_counts(spark):
    texts = ["The the tree, naïve!", "", None, "a b c " * 200, "x" * 5000, "--- ..."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.embedding for r in ops.hashed_vectors(df, "id", "text", "p: ").collect()}
    for i, text in enumerate(texts):
        want = np.zeros(ops.SLOTS)
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ("p: " + (text or "")).lower()):
            digits = hashlib.md5(word.encode()).hexdigest()
            want[int(digits[:8], 16) % ops.SLOTS] += 1 if digits[8] < "8" else -1
        assert got[i] == pytest.approx(list(want / np.linalg.norm(want)))
    bare = {r.id: r.embedding for r in ops.hashed_vectors(df, "id", "text").collect()}
    assert set(bare) == set(range(6)) and all(not any(bare[i]) for i in (1, 2, 5))


def test_words_of_texts_are_what_the_pattern_parts():
    texts = ["..ab cd", "", "é-ñ_", "cd", "ab", "\x00\x7f", "x" * 3000, "ﬁ 7"]
    for rows in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts, pa.large_string()).slice(1, 4), pa.array([], pa.string()), pa.array(["", ""])):
        words, n = text.byte_words(rows, ops.NO_WORD_CHARACTERS)
        parted = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) for t in rows.to_pylist()]
        assert [w.decode() for w in words.to_pylist()] == [w for p in parted for w in p] and list(n) == [len(p) for p in parted]


def test_hashed_vectors_of_stretches_without_words_and_of_parted_texts(spark):
    rows = [(i, t) for i, t in enumerate(["", "...", None, "ab", "cd", "Ñandú ñANDÚ", ""])]
    got = {r.id: np.array(r.embedding) for r in ops.hashed_vectors(spark.createDataFrame(rows, "id int, text string").coalesce(1), "id", "text").collect()}
    assert [int(np.count_nonzero(got[i])) for i in range(7)] == [0, 0, 0, 1, 1, 1, 0]


def test_hashed_vectors_shuffle_and_store_nothing(spark, capsys):
    df = spark.createDataFrame([(1, "una norma"), (1, "otra norma"), (2, "")], "id int, text string")
    out = ops.encode_passages(df)
    out.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert out.count() == 3  # rows of one key stay apart
    counts = {r.text: np.array(r.embedding) for r in ops.encode_passages(df, unit=False).collect()}
    for r in out.collect():
        c = counts[r.text]
        assert c.dtype.kind == "i" and r.embedding == pytest.approx(list(c / np.linalg.norm(c)))


def test_texts_go_to_python_in_stretches_bounded_by_bytes():
    rows = pa.array(["x" * 1000] * 5000 + [None, ""])
    parts = list(text.stretches(rows))
    assert pa.concat_arrays(parts).equals(rows)
    assert max(p.nbytes for p in parts) <= text.STRETCH_BYTES * 1.1
    assert max(len(p) for p in text.stretches(rows, 10)) == 10


def test_moments_on_the_edge_of_rounding_equal_their_sql(spark, tmp_path):
    """The length of these vectors is 96 and their moment ends in exactly half of the fourth decimal."""
    def place(word):
        digits = hashlib.md5(word.encode()).hexdigest()
        return int(digits[:8], 16) % ops.SLOTS, 1 if digits[8] < "8" else -1

    rng, repeats, wanted = np.random.default_rng(5), (95, 13, 4, 2, 1), {}
    while len(wanted) < 40:
        words = ["passage", *(f"w{i}" for i in rng.integers(0, 100_000, 5))]
        at = [place(w) for w in words]
        moment = sum((slot + 1) * sign * n for (slot, sign), n in zip(at, (1, *repeats)))
        if len({slot for slot, _ in at}) == 6 and 20_000 * moment % 96 == 0 and 20_000 * moment // 96 % 2:
            wanted[len(wanted)] = " ".join(" ".join([w] * n) for w, n in zip(words[1:], repeats)), round(Fraction(moment, 96), 4)
    spark.createDataFrame([(i, t) for i, (t, _) in wanted.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.moment for r in registry.queries()["passage_vectors"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = {r[0]: r[-1] for r in con.execute(registry.oracle_sql()["passage_vectors"]).fetchall()}
    assert got == theirs == {i: float(m) for i, (_, m) in wanted.items()}
