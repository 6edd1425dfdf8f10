"""Ranked lexical search over document FP-trees.

Documents are reduced to the terms that queries hold, as (term, count) vectors in order of falling document frequency.
Sorted by range, vectors with common prefixes lie together; every task builds tries of its stretch: a path is a shared
prefix, chains are one node, and stretches of at most ``LEAF`` vectors are a leaf. Each node keeps, for every term below
it, the largest count, and the smallest length norm m. A score rises with counts and falls with m, so these two bound what
a subtree can score for a query. Each query walks a trie depth first, the most promising child first, and leaves out
subtrees that cannot enter its best ``k``; a leaf is scored exactly. What a query has found in one trie of a task is the
bar for the next. Each task returns at most k rows a query; slices of tasks are merged before the whole.

Documents with equal vectors and equal m score alike: they are one vector with their k smallest keys (others cannot be
among the best). So a text on a third of all rows is a few rows per task. A task builds a trie whenever ``CHUNK`` counts
are together, so its memory does not grow with its stretch. Queries are taken in blocks of about ``QUERY_BYTES`` of text,
chosen by a hash of their key; the terms of a block are what is broadcast.

Null and empty texts have no terms: such documents count nowhere, such queries have no results. Rows with one query key
(null included) are one query with the terms of all their texts. Document keys are whole numbers, may repeat (each row is
a document) and may be null (then last among equal scores). Very long texts are read whole. Other columns are not looked
at. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almenara.llm.arrays import UPPER, WORD, Hasher, pieces, runs
from almenara.session import pin

K = 50
LEAF = 64
CHUNK = 4_000_000
#: Ranges are told apart by which of so many commonest terms a document holds; only these bits are sampled by Spark.
HEAD = 256
QUERY_BYTES = 32 << 20
#: Tasks whose results are merged in one slice before all slices are.
SLICE = 64

#: Fixed values of the score.
WEIGHT_SCALE, GAIN_SCALE, COUNT_SCALE, NORM_SCALE, NORM_BASE = 1000, 1_000_000_000, 1000, 20, 50

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


class Vocabulary:
    """Numbers of the words of a byte array that are among given terms; equality is checked on the bytes."""

    def __init__(self, terms: Iterable[str]) -> None:
        encoded = sorted(term.encode() for term in terms)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.cumsum([len(t) for t in encoded], dtype=np.int64)
        starts = ends - np.asarray([len(t) for t in encoded], np.int64)
        hashes = Hasher(data)(starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.data, self.hashes, self.starts, self.sizes = data, hashes[order], starts[order], (ends - starts)[order]
        self.names = [encoded[i].decode() for i in order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words that are no term."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = Hasher(data)(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == ends - starts))
        for size in np.unique(self.sizes[at[held]]):
            some = held[self.sizes[at[held]] == size]
            span = np.arange(size)
            same = (data[starts[some][:, None] + span] == self.data[self.starts[at[some]][:, None] + span]).all(axis=1)
            out[some[same]] = at[some[same]]
        return out


def vectors(batches: Iterable[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Documents with a term of any kind: key, number of terms, known terms and their counts."""
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column(1)):
            data = data.copy()
            data[UPPER[data]] += 32
            starts, ends, owner = runs(WORD[data], at)
            n = np.bincount(owner, minlength=hi - lo)
            numbers = known.numbers(data, starts, ends)
            hit = numbers >= 0
            width = max(len(known.names), 1)
            pairs, counts = np.unique(owner[hit] * width + numbers[hit], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(hi - lo + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))) for values in (pairs % width, counts)]
            made = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], names=["key", "n", "terms", "counts"])
            yield made.filter(pa.array(n > 0))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and their offsets from 0."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def ordered(batches: Iterable[pa.RecordBatch], rank: np.ndarray, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """Vectors in order of term rank, with the length norm m and, as a few bytes that sort alike, the commonest terms."""
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, at = flat(batch.column(2))
        counts, _ = flat(batch.column(3))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        order = np.lexsort((rank[terms], owner))
        m = NORM_BASE + NORM_BASE * np.asarray(batch.column(1)).astype(np.int64) * documents // total
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values[order].astype(np.int32))) for values in (rank[terms], counts)]
        head = np.zeros((batch.num_rows, HEAD // 8), np.uint8)
        early = rank[terms] < HEAD
        np.bitwise_or.at(head, (owner[early], rank[terms][early] >> 3), (128 >> (rank[terms][early] & 7)).astype(np.uint8))
        heads = pa.array([row.tobytes() for row in ~head], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m), *lists, heads], names=["key", "m", "path", "counts", "head"])


def gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return GAIN_SCALE * counts // (COUNT_SCALE * counts + NORM_SCALE * m)


@dataclass
class Level:
    """Children, documents or nodes, by number: (child * width + term) -> count, norm, smallest key, and where theirs begin."""

    places: np.ndarray
    counts: np.ndarray
    m: np.ndarray
    key: np.ndarray

    def bounds(self, lo: int, hi: int, terms: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """The most that each of the children lo to hi can score; of a document, its score."""
        wanted = np.arange(lo, hi)[:, None] * width + terms
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        counts = np.where(self.places[at] == wanted, self.counts[at], 0)
        return gain(counts, self.m[lo:hi, None]) @ weights


class Trie:
    """The FP-tree of a sorted stretch of vectors."""

    def __init__(self, key: np.ndarray, null: np.ndarray, m: np.ndarray, path: np.ndarray, counts: np.ndarray, at: np.ndarray, width: int, k: int) -> None:
        self.width = width
        size = np.diff(at)
        rows = len(size)
        # How far each vector agrees with the one before it, and whether all of it does.
        inside = np.arange(len(path)) - np.repeat(at[:-1], size)
        back = np.repeat(np.concatenate([[0], at[:-2]]), size) + inside
        there = inside < np.repeat(np.concatenate([[0], size[:-1]]), size)
        back = np.where(there, back, 0)
        same = there & (path[back] == path)
        shared = np.minimum.reduceat(np.where(same, len(path), inside), at[:-1])
        shared = np.minimum(shared, size)
        equal = np.logical_and.reduceat(same & (counts[back] == counts), at[:-1])
        equal[1:] &= (size[1:] == size[:-1]) & (m[1:] == m[:-1])
        equal[0] = False
        group = np.cumsum(~equal) - 1
        first = np.flatnonzero(~equal)
        kept = np.arange(rows) - first[group] < k
        self.keys, self.nulls = key[kept], null[kept]
        self.key_at = np.searchsorted(group[kept], np.arange(len(first) + 1))
        mask = np.repeat(~equal, size)
        owner = np.repeat(np.arange(len(first)), size[first])
        self.documents = Level(owner * width + path[mask], counts[mask], m[first], key[first])
        self._grow(shared[first])

    def _grow(self, shared: np.ndarray) -> None:
        """Nodes in breadth-first order, so the children of a node have consecutive numbers."""
        spans = [(0, len(shared))]
        self.first_child, self.last_child, self.leaf = [], [], []
        done = 0
        while done < len(spans):
            lo, hi = spans[done]
            done += 1
            self.leaf.append(hi - lo <= LEAF)
            if self.leaf[-1]:
                self.first_child.append(lo)
                self.last_child.append(hi)
                continue
            inner = shared[lo + 1 : hi]
            edges = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
            self.first_child.append(len(spans))
            begin = lo
            for left, right in zip(edges, edges[1:]):  # neighbours share a node while they fit a leaf
                if right - begin > LEAF and begin < left:
                    spans.append((begin, left))
                    begin = left
                if right - begin > LEAF:
                    spans.append((begin, right))
                    begin = right
            if begin < hi:
                spans.append((begin, hi))
            self.last_child.append(len(spans))
        self.nodes = self._maxima(spans)

    def _maxima(self, spans: list[tuple[int, int]]) -> Level:
        """Largest counts below each node, leaves first, from the last node to the root."""
        docs, width = self.documents, self.width
        terms: list[np.ndarray] = [np.zeros(0, np.int64)] * len(spans)
        tops: list[np.ndarray] = [np.zeros(0, np.int64)] * len(spans)
        for v in range(len(spans) - 1, -1, -1):
            if self.leaf[v]:
                lo, hi = np.searchsorted(docs.places, (spans[v][0] * width, spans[v][1] * width))
                t, c = docs.places[lo:hi] % width, docs.counts[lo:hi]
            else:
                below = range(self.first_child[v], self.last_child[v])
                t, c = np.concatenate([terms[u] for u in below]), np.concatenate([tops[u] for u in below])
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            edge = np.flatnonzero(np.diff(t, prepend=-1))
            terms[v], tops[v] = t[edge], np.maximum.reduceat(c, edge)
        places = np.concatenate([t + v * width for v, t in enumerate(terms)])
        least = lambda values: np.asarray([values[lo:hi].min() for lo, hi in spans])
        return Level(places, np.concatenate(tops), least(docs.m), least(docs.key))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put into ``best`` what this trie holds for a query; returns how many vectors were scored."""
        scored = 0
        stack = [(int(self.nodes.bounds(0, 1, terms, weights, self.width)[0]), 0)]
        while stack:
            bound, v = stack.pop()
            if not best.open(bound, int(self.nodes.key[v])):
                continue
            lo, hi = self.first_child[v], self.last_child[v]
            if self.leaf[v]:
                scored += hi - lo
                scores = self.documents.bounds(lo, hi, terms, weights, self.width)
                for i in np.flatnonzero(scores >= max(best.bar, 1)).tolist():
                    a, b = self.key_at[lo + i], self.key_at[lo + i + 1]
                    best.add(int(scores[i]), self.keys[a:b].tolist(), self.nulls[a:b].tolist())
            else:
                bounds = self.nodes.bounds(lo, hi, terms, weights, self.width)
                order = np.argsort(bounds, kind="stable")
                order = order[bounds[order] >= max(best.bar, 1)]
                stack += zip(bounds[order].tolist(), (lo + order).tolist())
        return scored


class Best:
    """The k highest scores of a query, equal ones by key with null last."""

    def __init__(self, k: int) -> None:
        self.k, self.heap, self.bar = k, [], 0

    def open(self, bound: int, key: int) -> bool:
        """Whether something of this bound, with no smaller key than this, may enter."""
        return bound > 0 and (len(self.heap) < self.k or bound > self.bar or (bound == self.bar and -key >= self.heap[0][2]))

    def add(self, score: int, keys: list[int], nulls: list[bool]) -> None:
        for key, null in zip(keys, nulls):
            entry = (score, not null, -key)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
            else:
                break
        self.bar = self.heap[0][0] if len(self.heap) == self.k else 0


def walk(batches: Iterable[pa.RecordBatch], queries: list[tuple[np.ndarray, np.ndarray]], width: int, k: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """A task's best k documents of each query."""
    best = [Best(k) for _ in queries]
    held: list[pa.RecordBatch] = []
    entries = 0

    def look() -> None:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        path, at = flat(table.column(2))
        key = table.column(0)
        null = np.asarray(key.is_null())
        trie = Trie(np.asarray(key.fill_null(np.iinfo(np.int64).max)), null, np.asarray(table.column(1)), path, flat(table.column(3))[0], at, width, k)
        for (terms, weights), found in zip(queries, best):
            trie.search(terms, weights, found)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        entries += len(batch.column(2).flatten())
        if entries >= chunk:
            look()
            held, entries = [], 0
    if held:
        look()
    rows = [(q, -key if known else None, score) for q, found in enumerate(best) for score, known, key in found.heap]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc", "score"])


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc").isNull(), "doc"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def block(documents: DataFrame, asked: list[tuple[object, str | None]], kind: str, k: int, chunk: int) -> DataFrame:
    """The best documents of one block of queries: (asked, rank, doc, score)."""
    spark = documents.sparkSession
    by_key: dict[object, set[str]] = {}
    for name, text in asked:
        by_key.setdefault(name, set()).update(terms_of(text))
    names = list(by_key)
    known = spark.sparkContext.broadcast(Vocabulary(set().union(*by_key.values())))
    size = len(known.value.names)
    held = pin(documents.mapInArrow(lambda batches: vectors(batches, known.value), "key long, n long, terms array<int>, counts array<int>"))
    n, total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = np.zeros(max(size, 1), np.int64)
    for term, count in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term
        frequency[term] = count
    order = np.argsort(-frequency, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weight = np.zeros(len(order), np.int64)
    number = {name: i for i, name in enumerate(known.value.names)}
    for i, df in enumerate(frequency[:size].tolist()):
        weight[rank[i]] = math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * df + 1)))
    queries = []
    for name in names:
        terms = np.asarray(sorted(rank[number[t]] for t in by_key[name] if frequency[number[t]]), np.int64)
        queries.append((terms, weight[terms]))
    shared = spark.sparkContext.broadcast((rank, queries))
    vectored = held.filter(F.size("terms") > 0).mapInArrow(lambda batches: ordered(batches, shared.value[0], n, total), "key long, m long, path array<int>, counts array<int>, head binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = (F.col("path"), F.col("counts"), F.col("m"), F.col("key").asc_nulls_last())
    dealt = vectored.repartitionByRange(parts, "head", "key").drop("head").sortWithinPartitions(*along)
    width = len(order)
    found = dealt.mapInArrow(lambda batches: walk(batches, shared.value[1], width, k, chunk), "query int, doc long, score long")
    sliced = top(found.withColumn("slice", F.floor(F.spark_partition_id() / SLICE)), ["query", "slice"], k).drop("rank", "slice")
    asked_rows = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"_query int, asked {kind}")
    best = top(sliced, ["query"], k)
    return best.join(F.broadcast(asked_rows), F.col("query") == F.col("_query")).select("asked", "rank", "doc", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", chunk: int = CHUNK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best documents of each query: query key, rank, document key, score."""
    docs = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    asked = queries.select(F.col(query_key).alias("asked"), F.col(query_text).alias("text"))
    kind = asked.schema["asked"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / query_bytes))
    out = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == number).collect()
        if rows:
            part = block(docs, [tuple(r) for r in rows], kind, k, chunk)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], f"asked {kind}, rank int, doc long, score long")
    return out.select(F.col("asked").alias(query_key), "rank", F.col("doc").alias(key), "score")
