"""Search and its evaluation against brute force."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from almenara.functions.text import words
from almenara.operators import documents as docs
from almenara.operators import index, lexical, retrieval as ops


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    v[100:240] = v[100]  # a third of the corpus are copies of one vector
    q = np.vstack([rng.normal(size=(20, 12)), v[100:101]]).astype(np.float32)
    corpus = spark.createDataFrame([(i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)], "id long, part int, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, i % 3, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, part int, embedding array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    return corpus, queries, np.round(unit(q) @ unit(v).T, 6)


def check(found, scores, k, allowed=None):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    for j, s in enumerate(scores):
        ids = np.arange(len(s)) if allowed is None else np.flatnonzero(allowed[j])
        best = ids[np.lexsort((ids, -s[ids]))][:k]
        assert [i for _, i, _ in sorted(got[j])] == list(best)
        assert [x for _, _, x in sorted(got[j])] == pytest.approx(list(s[best]))


def test_search_is_exact_and_copies_tie_by_id(vectors):
    corpus, queries, scores = vectors
    check(ops.semantic_search(corpus, queries, 7), scores, 7)


@pytest.mark.parametrize("blocks, rows, cells", [(1, 4, 50), (9, 1024, 2_000_000), (600, 3, 1)])
def test_blocks_and_steps_do_not_change_the_answer(vectors, monkeypatch, blocks, rows, cells):
    corpus, queries, scores = vectors
    monkeypatch.setattr(ops, "QUERY_ROWS", rows)
    monkeypatch.setattr(ops, "CELLS", cells)
    check(ops.semantic_search(corpus, queries, 7, blocks=blocks), scores, 7)


def test_more_queries_than_any_batch(spark):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(50, 4)).round(2), rng.normal(size=(3000, 4)).round(2)
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    check(ops.semantic_search(corpus, queries, 3), np.round(unit(q) @ unit(v).T, 6), 3)


def test_a_search_starts_no_job_before_it_is_asked_for(spark, vectors):
    corpus, queries, _ = vectors
    spark.sparkContext.setJobGroup("plan", "plan")
    ops.semantic_search(corpus, queries, 7)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert not list(started)


def test_scope_restricts_each_query(vectors):
    corpus, queries, scores = vectors
    allowed = (np.arange(21)[:, None] % 3) == (np.arange(400)[None, :] % 3)
    check(ops.semantic_search(corpus, queries, 5, scope="part"), scores, 5, allowed)


def test_no_queries_and_small_corpora(vectors):
    corpus, queries, _ = vectors
    assert ops.semantic_search(corpus, queries.filter("query_id < 0"), 5).count() == 0
    assert ops.semantic_search(corpus.filter("id < 3"), queries, 5).count() == 21 * 3


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query) for d in docs]


@pytest.mark.parametrize("limit", [1, 5])
def test_bm25_equals_the_formula(spark, limit):
    rng = np.random.default_rng(2)
    vocab = [f"t{i}" for i in range(30)]
    docs = [["The"] * 3 + list(rng.choice(vocab, rng.integers(1, 40))) for _ in range(60)]
    asked = [["the", "t1", "t1", "T2"], ["t7"], ["missing"], ["t3", "t4", "t5"], []]
    corpus = spark.createDataFrame([(i, "\n ".join(d)) for i, d in enumerate(docs)], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "query_id long, text string")
    found = {}
    for r in ops.bm25_search(corpus, queries, 4, blocks=limit).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    low = [[t.lower() for t in d] for d in docs]
    for j, q in enumerate(asked):
        s = np.round(okapi(low, [t.lower() for t in q]), 6)
        best = np.lexsort((np.arange(60), -s))[:4]
        assert [i for _, i, _ in sorted(found[j])] == list(best)
        assert [x for _, _, x in sorted(found[j])] == pytest.approx(list(s[best]), abs=1e-6)


def test_evaluation_counts(spark):
    queries = spark.createDataFrame([(1, "in_domain"), (2, "in_domain"), (3, "in_domain"), (4, "out_domain"), (5, "out_domain")], "query_id int, kind string")
    hits = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.8, True), (2, 1, 0.85, False), (2, 3, 0.7, True), (3, 1, 0.5, False), (4, 1, 0.95, False)],
                                 "query_id int, rank int, similarity double, relevant boolean")
    ranked = ops.first_hit(queries, hits)
    s = ops.retrieval_scores(ranked).first()
    assert (s.recall_at_1, s.recall_at_3, s.recall_at_5) == (0.3333, 0.6667, 0.6667)
    assert (s.right_abstentions, s.wrong_abstentions, s.max_similarity_out) == (1, 1, 0.95)
    sweep = ops.threshold_sweep(ranked, (0.4, 0.6, 0.82, 0.99))
    assert {r.threshold: r.right_total for r in sweep.collect()} == {0.4: 4, 0.6: 3, 0.82: 3, 0.99: 2}
    assert ops.best_threshold(sweep).first().threshold == 0.4
    d = {r.query_id: r.decision for r in ops.decide(queries, hits).collect()}
    assert d == {1: "responder", 2: "responder", 3: "similitud baja", 4: "responder", 5: "sin resultados"}


def test_gold_sets_drop_rare_themes_and_keep_all_ids(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "Obra de AGUA").otherwise("otra").alias("t"))
    out = ops.gold_by_pattern(df, {"a": "agua|desag[uü]e", "b": "inexistente", "c": "otra"}, "k", F.col("t")).collect()
    assert {(r.theme, r.relevant) for r in out} == {("a", 50), ("c", 50)}
    assert sorted(r.k for r in out if r.theme == "a") == list(range(0, 100, 2))


def test_context_and_notes(spark):
    hits = spark.createDataFrame([(1, 2, 0.5, "ley", 3, False, "dos"), (1, 1, 0.91234, "ds", 7, True, "uno"), (2, 4, 0.5, "ds", 1, True, "x")],
                                 "query_id int, rank int, similarity double, doc string, page int, amends boolean, text string")
    text = {r.query_id: r.context for r in ops.context_blocks(hits).collect()}[1]
    assert text == "--- Fragmento 1 · [ds, p. 7] (NORMA MODIFICATORIA) · similitud 0.912 ---\nuno\n\n--- Fragmento 2 · [ley, p. 3] · similitud 0.500 ---\ndos"
    assert {r.query_id: r.needs_note for r in ops.amendment_notes(hits).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("raw, answer, abstains, reason", [
    (json.dumps({"puede_responder": True, "respuesta": " si ", "citas": ["ley, p. 1", " "]}), "si\n\nFuentes citadas: [ley, p. 1]", False, ""),
    (json.dumps({"respuesta": "ya cita [a]", "citas": ["a"]}), "ya cita [a]", False, ""),
    (json.dumps({"puede_responder": False, "respuesta": "", "motivo": " fuera ", "citas": ["a"]}), "", True, "fuera"),
    ("no es json {", "no es json {", False, ""), ("[1, 2]", "[1, 2]", False, ""), ("{\"respuesta\": ", "{\"respuesta\": ", False, ""),
])
def test_model_answers(spark, raw, answer, abstains, reason):
    r = ops.parse_answers(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.answer, r.abstains, r.reason) == (answer, abstains, reason)


def test_index_load_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    index.load_index(a, path)
    index.load_index(a.unionByName(spark.createDataFrame([("z", 3)], "id string, v int")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="id unico"):
        index.load_index(a.unionByName(a), path)
    index.rebuild_index(a, path)
    assert spark.read.parquet(path).count() == 2


def test_a_small_load_reads_few_files_and_a_replay_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    index.load_index(spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v")), path, batch="first")
    stored = spark.read.parquet(path)
    ten = spark.range(4995, 5005).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("v"))
    read = index.touched(ten, stored).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 10 and stored.select(F.input_file_name().alias("f")).distinct().count() == index.FOLDERS
    for _ in range(2):
        index.load_index(ten, path, batch="second")
    assert index.finished(spark, path, "second") and not index.finished(spark, path, "third")
    more = spark.createDataFrame([("new", 2)], "id string, v int")
    index.load_index(more, path, batch="second")  # a finished batch is skipped
    index.load_index(ten, path)                   # a batch that was cut off is compared with the rows
    rows = index.read_index(spark, path)
    assert rows.columns == ["id", "v"] and (rows.count(), rows.filter("v = 1").count()) == (5005, 5)
    index.compact(spark, path)
    assert index.read_index(spark, path).count() == 5005
    index.rebuild_index(more, path)
    assert not index.finished(spark, path, "second") and index.read_index(spark, path).collect() == more.collect()


def passages(seed, n, words=60):
    rng = np.random.default_rng(seed)
    share = 1 / (np.arange(words) + 1)
    return [" ".join(f"w{t}" for t in rng.choice(words, rng.integers(0, 40), p=share / share.sum())) for _ in range(n)]


def test_pruned_bm25_loses_nothing(spark):
    """Long and short queries over copies, against every score; what is scored in full is a part of what shares a term."""
    docs = passages(5, 600) + ["w0 w1 w50"] * 300
    asked = passages(6, 12) + ["w0 w0 w1", "w59", "w58 w57 w0 w1 w2"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(6)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    tokens = [d.split() for d in docs]
    for k in (1, 5, 40):
        found = {}
        for r in ops.bm25_search(corpus, queries, k, blocks=5).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
        for j, q in enumerate(asked):
            s = np.round(okapi(tokens, q.split()), 6)
            best = np.lexsort((np.arange(len(s)), -s))[:k]
            assert [i for _, i, _ in sorted(found[j])] == list(best)
            assert [x for _, _, x in sorted(found[j])] == pytest.approx(list(s[best]), abs=1e-6)


def test_bm25_candidates_share_a_term_and_are_pruned(spark):
    docs, asked = passages(7, 800), passages(8, 10)
    corpus = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(6)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    weights = lexical.term_weights(corpus, queries)
    rows, mean = weights.agg(F.count("*"), F.max("mean_length")).first()
    held = lexical.postings(corpus, weights.select("term").distinct(), mean, 8)
    assert held.count() == sum(len({w for w in d.split()} & {w for q in asked for w in q.split()}) for d in docs)
    plan = lexical.reach(weights, held)
    open_, late = lexical.candidates(held, plan, rows, 5)
    got = {(r.query_id, r.id) for r in open_.collect()}
    sharing = {(j, i) for j, q in enumerate(asked) for i, d in enumerate(docs) if set(q.split()) & set(d.split())}
    assert got <= sharing and len(got) < len(sharing) / 2
    assert late.count() > 0


def test_bm25_joins_on_terms(spark):
    corpus = spark.createDataFrame(list(enumerate(passages(9, 50))), "id long, text string")
    terms = spark.createDataFrame([("w1",), ("w2",)], "term string")
    plan = lexical.postings(corpus, terms, 10.0, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi, (term" in plan and "MapInArrow" not in plan


def test_bm25_reads_words_once(spark):
    """A second time only for the mean idf, which the weight of a term in over half of the documents takes."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (read.add(1), t)[1])
    corpus = spark.createDataFrame([(i, f"all w{i % 7} w{i % 5} u{i}") for i in range(70)], "id long, text string").select("id", seen("text").alias("text"))
    for asked, times in (("w1 u3", 1), ("w1 all", 2)):
        before = read.value
        queries = spark.createDataFrame([(1, asked)], "query_id long, text string")
        assert ops.bm25_search(corpus, queries, 3).count() == 3
        assert read.value - before == 70 * times


ODD = [None, "", " \t\n", "Straße ÜBER über", "a\u00a0b a\x0bb\x0cc", "İi ǅ ǆ", "x" * 3000 + " x", "\ta a  A\r\nb\n", "日本 語 日本"]


def test_bm25_counts_words_as_the_column_expression_does(spark, monkeypatch):
    corpus = spark.createDataFrame(list(enumerate(ODD * 3)), "id long, text string").repartition(2)
    tokens = corpus.select("id", words(F.lower("text")).alias("w"))
    terms = tokens.select(F.explode("w").alias("term")).distinct()
    expected = {tuple(r) for r in tokens.select("id", F.size("w").alias("n"), F.explode("w").alias("t")).groupBy("id", "n", "t").count().collect()}
    documents = {(r.id, r.n, None, r.n) for r in tokens.select("id", F.size("w").alias("n")).collect()}
    whole = {tuple(r) for r in lexical.term_counts(corpus, lexical.and_documents(terms)).collect()}
    assert whole == expected | documents
    known = spark.sparkContext.broadcast(pa.array(["über", "a", "nowhere"]))
    for stretch in (1 << 20, 16):
        monkeypatch.setattr("almenara.functions.text.STRETCH_BYTES", stretch)
        some = {tuple(r) for r in lexical.entries(lexical.counted_documents(corpus, known)).collect()}
        assert some == {r for r in whole if r[2] in ("über", "a", None)}
        assert {tuple(r) for r in lexical.vocabulary(corpus).collect()} == {tuple(r) for r in terms.join(tokens.select("id", F.explode(F.array_distinct("w")).alias("term")), "term").groupBy("term").count().collect()}


def test_bm25_with_more_terms_than_are_broadcast(spark, monkeypatch):
    corpus = spark.createDataFrame(list(enumerate(passages(11, 200))), "id long, text string")
    queries = spark.createDataFrame(list(enumerate(passages(12, 8))), "query_id long, text string")
    few = sorted(map(tuple, ops.bm25_search(corpus, queries, 5).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, ops.bm25_search(corpus, queries, 5).collect())) == few


def test_bm25_without_queries_or_documents(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, text string")
    assert ops.bm25_search(corpus, queries.limit(0), 3).count() == 0
    assert ops.bm25_search(corpus.limit(0), queries, 3).count() == 0
    assert [(r.query_id, r["rank"], r.id) for r in ops.bm25_search(corpus, queries, 2).orderBy("query_id", "rank").collect()][0] == (1, 1, 1)


def clustered(rng, groups, size, dims, spread):
    centres = rng.normal(size=(groups, dims))
    return (centres[:, None, :] + spread * rng.normal(size=(groups, size, dims))).reshape(-1, dims)


def listed(m):
    return pa.array([[float(x) for x in r] for r in m], pa.list_(pa.float64()))


@pytest.mark.parametrize("spread, part", [(0.05, 0.2), (3.0, 1.01)])
def test_whole_clusters_are_skipped_without_loss(spread, part):
    rng = np.random.default_rng(8)
    v, q = clustered(rng, 40, 60, 16, spread), None
    v[17], v[18], v[100:160] = 0, 0, v[100]
    q = np.vstack([v[::97] + 0.01, rng.normal(size=(5, 16)), np.zeros((1, 16))])
    unit = lambda m: m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-300, None)
    block = ops.Block(np.arange(len(v)), listed(v))
    who, ids, s = block.search(*ops._units(listed(q)), None, 7)
    scores = np.round(unit(q) @ unit(v).T, 6)
    for j in range(len(q)):
        best = np.lexsort((np.arange(len(v)), -scores[j]))[:7]
        assert list(ids[who == j]) == list(best) and list(s[who == j]) == pytest.approx(list(scores[j][best]))
    assert block.scored <= part * scores.size


def test_blocks_follow_the_bytes_of_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v, q = clustered(rng, 10, 100, 8, 0.1), rng.normal(size=(9, 8))
    monkeypatch.setattr(ops, "BLOCK_BYTES", 16_000)  # 128 bytes a row
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    check(ops.semantic_search(corpus, queries, 4), np.round(unit(q) @ unit(v).T, 6), 4)
    n = math.ceil(len(v) * 128 * 2 / 16_000)
    sizes = corpus.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).count().collect()
    assert len(sizes) == n and max(r["count"] for r in sizes) * 128 <= 16_000


def test_text_ids_and_unusable_vectors(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", None)], "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.id, r.similarity) for r in ops.semantic_search(corpus, queries, 5).collect())
    assert found == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "c", 0.0), (2, 1, "a", 0.0), (2, 2, "b", 0.0), (2, 3, "c", 0.0)]


@pytest.mark.parametrize("waiting, cells", [(0, 40), (4096, 2_000_000)])
def test_texts_scored_where_they_are_read_equal_every_score(spark, monkeypatch, waiting, cells):
    monkeypatch.setattr(ops, "CANDIDATES", waiting)
    monkeypatch.setattr(ops, "CELLS", cells)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, rng.integers(0, 30)) % 500) for _ in range(900)]
    texts[300:420] = [texts[300]] * 120  # copies tie by id
    rows = [(f"d{i}", None if i % 4 == 3 else i % 4, i, None if i % 50 == 7 else t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "id string, part int, chars int, text string").repartition(5)
    asked = spark.createDataFrame([(i, texts[i * 60]) for i in range(12)] + [(12, None)], "query_id long, text string")
    vector = {r.id: np.array(r.embedding, float) for r in docs.encode_passages(corpus, unit=False).collect()}
    asking = docs.encode_queries(asked, unit=False)
    query = {r.query_id: np.array(r.embedding, float) for r in asking.collect()}
    ready = corpus.select("id", "part", "chars", docs.prepared(F.col("text"), docs.PASSAGE).alias("text"))
    for scope in ("part", None):
        hits, sums = ops.search_texts(ready, asking, 6, docs.word_counts, scope, "chars")
        got = sorted((str(r.part) if scope else "", r.query_id, r["rank"], r.id, r.similarity) for r in hits.collect())
        want, totals = [], []
        for value in sorted({r[1] for r in rows}, key=str) if scope else [""]:
            mine = [r for r in rows if not scope or r[1] == value]
            totals.append((str(value), len(mine), sum(r[2] for r in mine)))
            for q, a in query.items():
                scored = sorted((-round(float(vector[r[0]] @ a / (np.linalg.norm(vector[r[0]]) * np.linalg.norm(a))), 6), r[0]) for r in mine)[:6]
                want += [(str(value), q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want)])
        assert sorted((str(r[0]) if scope else "", r.n, r.total) for r in sums.collect()) == totals


def test_texts_without_queries_are_still_counted_and_words_that_cancel_have_no_direction(spark):
    corpus = spark.createDataFrame([("b", "una norma"), ("a", ""), ("c", None)], "id string, text string")
    asked = docs.encode_queries(spark.createDataFrame([(1, "una norma")], "query_id long, text string"), unit=False)
    ready = corpus.select("id", F.coalesce("text", F.lit("")).alias("text"))  # without a prefix: zero vectors
    hits, sums = ops.search_texts(ready, asked, 5, docs.word_counts)
    assert [(r["rank"], r.id) for r in hits.orderBy("rank").collect()] == [(1, "b"), (2, "a"), (3, "c")]
    for some in (corpus, corpus.limit(0)):
        hits, sums = ops.search_texts(some.select("id", F.coalesce("text", F.lit("")).alias("text")), asked.limit(0), 5, docs.word_counts)
        assert hits.count() == 0 and [r.n for r in sums.collect()] == ([3] if some is corpus else [])


def test_fragment_sizes_are_scored_where_they_are_read_and_in_blocks_alike(spark, tmp_path, monkeypatch, capsys):
    rng = np.random.default_rng(13)
    lines = [" ".join(f"w{i}" for i in rng.zipf(1.2, 400) % 3000) for _ in range(60)]
    items = [(i, " ".join(line.split()[100:130])) for i, line in enumerate(lines[::6])] + [(None, "w1 w2"), (99, None)]
    spark.createDataFrame([(i, ". ".join(lines[i % 60 : i % 60 + 3])) for i in range(80)] + [(80, None), (81, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    evaluation = registry.queries()["fragment_size_evaluation"]
    found = evaluation(spark, str(tmp_path))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "embedding" not in plan  # split once, vectors neither shuffled nor stored
    monkeypatch.setattr(ops, "QUERY_BYTES", 0)
    dealt = evaluation(spark, str(tmp_path))
    dealt.explain()
    assert "embedding" in capsys.readouterr().out
    assert dealt.columns == found.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, dealt.collect()))
    assert found.count() == 3 and found.filter("recall_at_5 > 0").count() == 3
