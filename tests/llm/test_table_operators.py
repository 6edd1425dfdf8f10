"""Mixing, sharding, Jaccard join, neighbours, components and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from almenara.llm import graph, jaccard, mixing, nearest, queries, sharding
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def filled(sizes, weights, total):
    """Targets by pouring: share by weight, cap, share the excess again."""
    target, open_ = {}, dict(weights)
    left = float(total)
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing_targets_and_choice(spark):
    rng = random.Random(1)
    docs = [(k, rng.choice(["b", "a", "z", "hot", "hot", "hot", None]), " ".join("w" * 3 for _ in range(rng.randint(0, 40)))) for k in range(400)]
    docs += [(900, "tiny", "one two"), (901, "none", None), (902, "none", ""), (903, "hot", "x " * 5000), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, source string, text string, copies string")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "source", "text", "copies"] and got.count() == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, s, t in docs:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    target = filled(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(total.values()))
    plan = {r["source"]: r for r in mixing.plan(mixing.sized(df)).collect()}
    assert all(math.isclose(plan[s]["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)
    taken, rows = Counter(), {}
    for r in got.collect():
        taken[r["source"]] += size(r["text"]) * r["copies"]
        rows.setdefault((r["doc_id"], r["text"]), set()).add(r["copies"])
        assert 0 <= r["copies"] <= 3
    assert all(len(c) == 1 for c in rows.values())
    longest = {s: max(size(t) for _, x, t in docs if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= longest[s] * (3 if s == docs[0][1] else 1) for s in names)
    again = Counter({(r["doc_id"], r["copies"]): 1 for r in mixing.mix(df.repartition(3)).collect()})
    assert again == Counter({(r["doc_id"], r["copies"]): 1 for r in got.collect()})
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_many_equal_rows(spark):
    rows = [(None, "hot", "ten words " * 5)] * 1000 + [(k, "other", "w " * 10) for k in range(1000)] + [(7, None, "x y")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    goal = {r["source"]: r["target"] for r in mixing.plan(mixing.sized(df)).collect()}
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split()) * r["copies"]
    assert all(abs(taken[s] - goal[s]) <= 5 for s in goal) and goal["hot"] % 10000 > 10


def test_shards_of_one_id_on_many_texts(spark):
    rows = [(1, f"text {k}") for k in range(3000)] + [(1, "same")] * 25_000 + [(k, "x") for k in range(50)]
    got = sharding.placed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == len(rows)
    for r in got.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n"), F.count("slot").alias("m")).collect():
        assert r["a"] == 0 and r["b"] + 1 == r["n"] == r["m"]
    assert got.filter("doc_id = 1").select("shard").distinct().count() == 1


def winner(key, shards):
    draws = []
    for s in range(shards):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        draws.append((1 / -math.log(u), -s))
    return -max(draws)[1]


def test_sharding_slots_and_growth(spark):
    docs = [(k, f"text é {k % 7}") for k in range(500)] + [(9, "text é 2")] * 40 + [(None, None), (None, "x"), (1, "other")]
    got = sharding.placed(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, shard int"))
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == winner(key, 16) and r["grown_shard"] == winner(key, 17)
        assert r["grown_shard"] in (r["shard"], 16)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.placed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_follow_their_weights(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    count = Counter(r["shard"] for r in sharding.assign(ids, weights=(3.0, 1.0, 1.0, 1.0), further=None).collect())
    assert abs(count[0] / 6000 - 0.5) < 0.03 and all(abs(count[k] / 6000 - 1 / 6) < 0.02 for k in (1, 2, 3))


def sets_of(docs):
    out = []
    for _, text in docs:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def linked(docs):
    """(id, class, links) by comparing every pair."""
    sets = sets_of(docs)
    label = list(range(len(docs)))
    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    smallest = {}
    for (doc, _), v in zip(docs, label):
        if doc is not None:
            smallest[v] = min(smallest.get(v, doc), doc)
    return sorted(((d, smallest.get(v), n) for (d, _), v, n in zip(docs, label, links)), key=str)


def joined(spark, docs):
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, class_id string")
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)


@pytest.mark.parametrize("limit, block", [(256, 400), (5, 4)])
def test_jaccard_join_matches_all_pairs(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for k in range(45):  # one large group of near copies, some of them beyond the threshold of each other
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = rng.choice(words)
        docs.append((k, " ".join(copy)))
    docs += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(80)]
    docs += [(300 + k, " ".join(base[:12] + [rng.choice(words) for _ in range(60)])) for k in range(30)]  # a shared passage only
    docs += [(400, None), (401, ""), (402, "?"), (403, "one two"), (404, "One, two!"), (405, "É t é"), docs[0], docs[0], (500, docs[1][1].upper()), (None, docs[60][1])]
    assert joined(spark, docs) == linked(docs)


@needs_tables
def test_jaccard_join_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, FOLDER, "documents").collect()]
    assert joined(spark, docs) == linked(docs)


def test_jaccard_join_of_nothing(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "a b c d e f")]) == [(1, 1, 0), (2, 2, 0)]
    assert jaccard.run_count() >= 5


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == got[200] == 200
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def nearest_by_force(rows, k):
    ok = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            ok[(key, tuple(v))] = np.array(v, np.float32).astype(float)
    out = {}
    for (q, v), x in ok.items():
        if q % 20 == 0:
            scores = sorted(((-float((x * y).sum()), key) for (key, _), y in ok.items() if key != q))
            out[q] = [key for _, key in scores[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).round(3).tolist()) for k in range(300)]
    twin = rng.normal(size=8).round(3).tolist()
    rows += [(1000 + k, twin) for k in range(150)]  # one very common vector, asked for as well
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [1.0] * 7), (2005, [None] + [1.0] * 7), (None, twin), (2006, [float("inf")] * 8), rows[0]]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest_by_force(rows, 20)
    assert set(got) == set(want)
    assert all([x[0] for x in v] == list(range(1, 21)) for v in got.values())
    hit = sum(len({x[1] for x in got[q]} & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    for q, rows in got.items():  # ties go to the smaller id
        twins = [x[1] for x in rows if 1000 <= x[1] < 1150]
        assert twins == [k for k in range(1000, 1150) if k != q][: len(twins)]
    assert all(a[2] >= b[2] for v in got.values() for a, b in zip(v, v[1:]))


def test_neighbours_of_few_vectors(spark):
    names = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], names)
    assert [(r["vec_id"], r["score"]) for r in nearest.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()] == [(1, 0.5), (2, -1.0)]
    assert nearest.search(spark.createDataFrame([], names), F.lit(True), 20).count() == 0
    assert nearest.search(df.limit(1), F.lit(True), 20).count() == 0


def test_huge_vectors_leave_the_others_lists_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    huge = [(1001, [1e200] + [0.0] * 7), (1002, [-1e300] * 8), (1003, [1e-200] * 8)]
    lists = []
    for more in ([], huge):
        got = nearest.search(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(found) == 20 and all(len(v) == 5 for v in found.values())
        lists.append(found)
    want = {r[0]: dict(rows)[r[0]] for r in rows if r[0] % 20 == 0}
    everything = {k: np.array(v) for k, v in rows + huge}
    for q, v in want.items():
        with np.errstate(over="ignore"):
            scores = {k: float((everything[k] * np.array(v)).sum()) for k in everything if k != q}
        giants = [k for k in sorted(scores, key=lambda k: (-scores[k], k))[:5] if k > 1000]
        assert lists[1][q][: len(giants)] == giants
        assert len(set(lists[0][q]) & set(lists[1][q])) >= 5 - len(giants) - 1


def test_isolated_vectors_have_whole_lists(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.vstack([np.repeat(rng.normal(size=(30, 32)), 100, axis=0) + 0.001 * rng.normal(size=(3000, 32)), rng.normal(size=(30, 32))]))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, (F.col("vec_id") >= 3000) | (F.col("vec_id") % 500 == 0), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {*range(3000, 3030), *range(0, 3000, 500)} and all(len(v) == 20 for v in got.values())
    hits = 0
    for q in range(3000, 3030):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 30


@needs_tables
def test_recall_on_embeddings(spark):
    rows = queries.table(spark, FOLDER, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    found = {}
    for r in queries.QUERIES["op7_multi_index_neighbours"](spark, FOLDER).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort([ids, -s])[:20]]))
    assert hits / (20 * len(found)) >= 0.9


@needs_tables
def test_pipeline_stage_by_stage(spark):
    docs = queries.table(spark, FOLDER, "documents").withColumn("extra", F.lit(1))
    columns = docs.columns
    kept = corpus_pipeline.good_quality(spark, docs, FOLDER)
    marks = {r["doc_id"]: r["quality"] for r in queries.table(spark, FOLDER, "labels").collect()}
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns
    assert all(k in left for k, q in marks.items() if q == 1)
    some = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None, 1), (9001, "", None, None, 0, 1)], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    one = corpus_pipeline.one_of_each(spark, some, FOLDER)
    want = sorted({str(d) for d, c, _ in linked(rows) if d == c})
    assert one.columns == columns and sorted(str(r["doc_id"]) for r in one.collect()) == want
    clean = corpus_pipeline.uncontaminated(spark, some, FOLDER)
    assert clean.columns == columns
    mixed = corpus_pipeline.mixture(spark, some, FOLDER)
    assert mixed.columns == columns
    copies = Counter()
    for r in mixing.mix(some).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert corpus_pipeline.shards(spark, mixed, FOLDER).count() == mixed.count()


def test_near_duplicates_are_judged_by_row(spark):
    base = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefg"]
    near = [b + " more" for b in base]
    rows = [
        (1, base[0]), (None, near[0]), (None, base[1]),  # a null id near a document with an id, and a unique one
        (2, base[2]), (3, near[2]), (3, base[3]),  # an id on a copy and on a unique text
        (None, base[4]), (None, near[4]), (None, base[5]), (None, base[5]),  # near and exact copies without ids
        (4, base[6]), (4, near[6]),  # one id on two near texts
        (None, None), (5, None), (6, ""),
    ]
    one = lambda r: Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.one_of_each(spark, spark.createDataFrame(r, "doc_id long, text string"), FOLDER).collect())
    for part in (rows, rows[::-1]):
        got = one(part)
        choice = {(None, base[4]), (None, near[4])}, {(4, base[6]), (4, near[6])}
        assert all(sum(got[r] for r in c) == 1 for c in choice)
        fixed = {r: n for r, n in got.items() if r not in set.union(*choice)}
        assert fixed == dict.fromkeys([rows[k] for k in (0, 2, 3, 5, 8, 12, 13, 14)], 1)
    assert one(rows[8:10]) == {rows[8]: 1}


@needs_tables
def test_pipeline_of_an_empty_table(spark):
    docs = queries.table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
