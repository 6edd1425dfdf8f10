"""Whitening, ranked search and packing against plain re-statements of their rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from almenara.llm import packing, ranked, whitening
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


# Whitening


def whitened(df, **options):
    return {(r["vec_id"], r["component"]): r for r in whitening.whiten(df, **options).collect()}


def expected(vectors, components=4):
    """n, sums, components and values over the distinct vectors."""
    x = np.unique(np.asarray([[math.floor(256 * c) for c in v] for v in vectors]), axis=0)
    total = x.sum(axis=0)
    centred = x - total / len(x)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:components]
    return len(x), total, axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    made = (rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 1).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(made)] + [(1000 + i, made[7]) for i in range(150)]
    dirty = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [NAN] + [1.0] * 5), (2003, [INF] + [1.0] * 5), (2004, [1e300] * 6), (2005, [])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows + dirty], "vec_id long, embedding array<double>, whitened string")


def test_whitening_equals_numpy(cloud):
    rows, df = cloud
    got = whitened(df)
    n, total, axes, share = expected([v for _, v in rows])
    assert len(got) == 4 * len(rows)
    plain = {i: (np.asarray([math.floor(256 * c) for c in v]) - total / n) @ axes for i, v in rows}
    ids = [i for i, _ in rows]
    ours = np.asarray([[got[i, c]["whitened"] for c in range(1, 5)] for i in ids])
    theirs = np.asarray([plain[i] for i in ids])
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * sign - theirs).max() < 1e-9
    for (i, c), r in got.items():
        x = [math.floor(256 * e) for e in dict(rows)[i]]
        assert r["n"] == n and r["deviation"] == sum((n * e - int(s)) ** 2 for e, s in zip(x, total))
        assert math.isclose(r["explained"], share[c - 1], rel_tol=1e-9) and r["identity_error"] < 1e-9


def test_whitening_blocks_of_few_rows_and_columns(cloud, monkeypatch):
    rows, df = cloud
    whole = whitened(df)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    cut = whitened(df)
    assert cut.keys() == whole.keys()
    assert all(abs(abs(cut[k]["whitened"]) - abs(whole[k]["whitened"])) < 1e-9 for k in whole)


def test_whitening_keys_null_and_repeated(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df).collect()
    assert Counter((r["vec_id"], r["component"]) for r in rows) == {(None, 1): 2, (None, 2): 2, (1, 1): 2, (1, 2): 2}
    assert {r["n"] for r in rows} == {3}


def test_whitening_components_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    assert whitening.whiten(flat.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(flat.limit(0)).count() == 0


def test_whitening_lengths_are_spaces_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [2.0]), (5, [4.0])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["n"]) for r in whitening.whiten(df).collect()} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)}


def test_whitening_large_sums_are_exact(spark):
    big = float(1 << 53)
    df = spark.createDataFrame([(i, [big, float(i)]) for i in range(3000)], "vec_id long, embedding array<double>").select("vec_id", "embedding", F.col("embedding").alias("x"))
    rows = df.select(whitening.whole(F.col("embedding")).alias("x"))
    assert whitening.sums(rows, 2) == (3000, [3000 * (1 << 61), 256 * sum(range(3000))])
    assert {r["deviation"] for r in whitening.whiten(df.select("vec_id", "embedding")).collect()} == {None}


# Ranked search


def ranking(documents, queries, k):
    """Every score, by the definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(key, Counter(low(text))) for key, text in documents]
    docs = [(key, c) for key, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    asked = defaultdict(set)
    for key, text in queries:
        asked[key] |= set(low(text))
    for query, terms in asked.items():
        scores = []
        for key, c in docs:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(query, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "naïve", "x", "X", "7up", "名前"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(n)], rng


@pytest.mark.parametrize("chunk", [40, 4_000_000])
def test_search_equals_all_scores(spark, chunk):
    docs, rng = corpus(3, 700)
    docs += [(1000 + i, docs[5][1]) for i in range(300)] + [(None, docs[5][1]), (None, None), (5000, ""), (5001, "?!"), (5, "w1 w30"), (5002, "w3 " * 20_000)]
    rng.shuffle(docs)
    queries = [(i, " ".join(rng.sample([f"w{j}" for j in range(40)] + ["X", "ärger", "Ärger", "unknown", "名前"], 5))) for i in range(12)]
    queries += [(20, docs[3][1]), (21, None), (22, "..."), (None, "w1 w2"), (23, "w9"), (23, "w20 W9")]
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, score string, n int").repartition(5)
    q = spark.createDataFrame(queries, "item_id int, text string")
    got = ranked.search(d, q, k=15, chunk=chunk)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(docs, queries, 15)


def test_search_in_blocks_of_queries(spark):
    docs, _ = corpus(4, 200)
    queries = [(f"q{i}", f"w{i} w{i + 7} w2") for i in range(10)]
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id string, text string"), k=5, query_bytes=200)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(docs, queries, 5)


def test_search_leaves_out_subtrees():
    """A trie over many vectors is not scored vector by vector, and what is found is the best."""
    rng = np.random.default_rng(2)
    rows = sorted((tuple(sorted(rng.choice(60, size=8, replace=False).tolist())), int(rng.integers(51, 400)), i) for i in range(5000))
    path, at = np.concatenate([r[0] for r in rows]), np.arange(0, 8 * len(rows) + 1, 8)
    counts = rng.integers(1, 5, len(path))
    m, key = np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows])
    trie = ranked.Trie(key, np.zeros(len(rows), bool), m, path, counts, at, 60, 10)
    terms, weights = np.asarray([0, 1, 40]), np.asarray([900, 700, 50])
    best = ranked.Best(10)
    scored = trie.search(terms, weights, best)
    scores = sorted(((-sum(int(w) * int(ranked.gain(c, n)) for t, w in zip(terms, weights) for c in counts[8 * i : 8 * i + 8][path[8 * i : 8 * i + 8] == t]), k) for i, (n, k) in enumerate(zip(m.tolist(), key.tolist()))))
    assert sorted((-s, -k) for s, _, k in best.heap) == scores[:10]
    assert scored < len(rows) / 4


def test_search_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0
    assert ranked.search(d, spark.createDataFrame([(1, None)], q.schema)).count() == 0


# Packing


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    tokenizer = Tokenizer.from_str(text)
    tokenizer.encode_special_tokens = True
    return text, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, documents, encode, capacity):
    """Every id in one piece, sequences without gaps, full but for ``WASTE``; returns padding and number of ids."""
    want = Counter(tuple([*encode(text), 0]) for _, text in documents)
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        assert r["length"] == len(r["ids"]) // 4
    if len({key for key, _ in documents}) == len(documents):
        got = Counter()
        for (_, total), pieces in parts.items():
            pieces.sort()
            assert [s for s, _ in pieces] == [sum(len(x) for _, x in pieces[:i]) for i in range(len(pieces))]
            ids = tuple(i for _, x in pieces for i in x)
            assert len(ids) == total
            got[ids] += 1
        assert got == want
    else:
        assert sum(r["length"] for r in rows) == sum(len(ids) * m for ids, m in want.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        pieces.sort()
        end = 0
        for offset, length in pieces:
            assert offset == end
            end += length
        assert end <= capacity
        if end & (end - 1):
            padding += capacity - end
            assert capacity - end <= packing.WASTE
    return padding, sum(r["length"] for r in rows)


def test_packing_round_trip(spark, vocabulary):
    text, encode = vocabulary
    rng = random.Random(9)
    words = ["tree", " of", "life", "\n\n", "naïve", "東京", "it's", "<|endoftext|>", "   ", "x" * 30, "🙂", "\x1c", "ˁ"]
    documents = [(i, " ".join(rng.choices(words, k=rng.randint(0, 900)))) for i in range(150)]
    documents += [(900, None), (901, ""), (902, "long " * 60_000), (903, "y" * 20_000)]
    df = spark.createDataFrame([(*d, "a", 1) for d in documents], "doc_id long, text string, ids string, start int").repartition(4)
    got = packing.pack(df, text)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    padding, total = check_packing(got.collect(), documents, encode, packing.CAPACITY)
    assert padding <= total * packing.WASTE / packing.CAPACITY


def test_packing_small_capacity_repeats_and_null_keys(spark, vocabulary):
    text, encode = vocabulary
    documents = [(None, "one two three")] * 40 + [(1, "four five")] * 70 + [(2, None)] * 33 + [("3", "six " * 100)][:0]
    rows = packing.pack(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), text, capacity=16, waste=1).collect()
    check_packing(rows, documents, encode, 16)
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == {None: 40, 1: 70, 2: 33}


def test_packing_empty_table_and_bad_capacity(spark, vocabulary):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(empty, vocabulary[0]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, vocabulary[0], capacity=1000)


def test_cuts_add_up_and_fill_sequences():
    table = packing.cuts()
    for length in range(1, packing.CAPACITY):
        assert sum(table[length]) == length
        for size in table[length]:
            assert packing.CAPACITY - packing.CAPACITY // size * size <= packing.WASTE
    assert max(map(len, table)) <= 5


def test_encoder_equals_tokenizers(vocabulary):
    text, encode = vocabulary
    encoder = packing.Encoder(text)
    assert encoder.fast is not None
    rng = random.Random(4)
    letters = sorted(encoder.settled)
    for _ in range(3000):
        made = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(" \n\t\r's19a-é.") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(encoder(made), "<u4").tolist() == encode(made)
    assert zlib.crc32(encoder("<|endoftext|>")) == zlib.crc32(np.asarray(encode("<|endoftext|>"), "<u4").tobytes())
