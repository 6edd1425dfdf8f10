"""Approximate nearest neighbours by inner product with multi-index hashing.

Vectors become binary codes: centred, projected on their main directions and turned by the rotation that brings them
closest to the corners of a cube (learned by alternating, on a sample of about ``SAMPLE_ROWS`` vectors chosen by a
hash of the id). As inner products depend on length, a further coordinate brings all stored vectors to one length;
vectors over ``LONG`` times as long as the 999th of a thousand are compared with every query instead.
A code is cut into ``PARTS`` substrings, each indexed by its value. Two codes within Hamming distance r are within
r_j in at least one substring j when the r_j + 1 sum to r + 1, so probing the stored values within r_j of the
query's retrieves every code within r, and nothing within r is lost. The retrieved are ranked by their float vectors.

The radius is measured on the sample: the distance within which ``RECALL`` of true neighbours lie. On data without
near neighbours it is wide and most of the index is probed; that is what the recall costs. Queries that hold fewer
than ``k`` neighbours after that, as isolated vectors of clustered data do, are searched again with all bits as the
radius, which is exact; no query has a short list while there are more candidates.

Queries meet the index in blocks of bounded size: each task has one block of queries and one block of the index, and
passes on the best ``k + 1`` of each query. Equal vectors are searched once: of each, the ``k + 1`` smallest ids are
all that any answer can show.

Null vectors, zero vectors, vectors with a null, NaN or infinite component, of another length than most, and rows
without id take no part. Rows of equal id and vector are one. Fewer candidates than ``k`` give shorter lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almenara.llm.graph import groups
from almenara.session import pin

BITS = 64
PARTS = 4
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
RECALL = 0.97
INDEX_BLOCK = 8_192
QUERY_BLOCK = 2_048
ROUNDS = 30
LONG = 4.0


@dataclass
class Model:
    """Centre, projection with rotation, greatest length, number of bits and the Hamming radius."""

    centre: np.ndarray
    turn: np.ndarray
    longest: float
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """Codes of rows of ``x`` as 64-bit numbers."""
        flat = augmented(x, self.longest if stored else None)
        on = ((flat - self.centre) @ self.turn) > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def part_radii(self) -> list[int]:
        """Radius of each substring: with the pigeonhole's one to spare, they sum to the radius."""
        each, over = divmod(self.radius + 1, PARTS)
        return [each - 1 + (j < over) for j in range(PARTS)]


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of rows, as directions and a power so that no square overflows: (largest component, x over it, length over it)."""
    most = np.abs(x).max(axis=1, keepdims=True)
    turned = x / most
    return most, turned, np.sqrt((turned * turned).sum(axis=1, keepdims=True))


def augmented(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Rows with the coordinate that brings all to one length: stored ones over ``longest``, at most 1; queries over their own."""
    most, turned, length = lengths(x)
    share = np.minimum(most / longest * length, 1.0) if longest else np.ones_like(length)
    more = np.sqrt(np.maximum(1 - share * share, 0)) if longest else np.zeros_like(length)
    return np.hstack([turned / length * share, more])


def giants(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows longer than the codes allow for; they are compared with every query."""
    most, _, length = lengths(x)
    return (most / longest * length > 1)[:, 0]


def learn(x: np.ndarray, longest: float, k: int, total: int, seed: int = 11) -> Model:
    """Codes and radius from a sample of a table of ``total`` vectors."""
    rng = np.random.default_rng(seed)
    x = x[~giants(x, longest)]
    flat = augmented(x, longest)
    centre = flat.mean(axis=0)
    bits = min(BITS, x.shape[1])
    values, vectors = np.linalg.eigh(np.cov((flat - centre).T) if len(x) > 1 else np.eye(flat.shape[1]))
    main = vectors[:, np.argsort(-values)[:bits]]
    z = (flat - centre) @ main
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ vt).T
    model = Model(centre, main @ turn, longest, bits)
    if len(x) > k + 1:
        # The neighbours wanted in the whole table are this many in the sample.
        wanted = min(len(x) - 1, max(1, round(k * len(x) / max(total, 1))))
        at = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
        scores = x[at] @ x.T
        scores[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]
        far = np.bitwise_count(model.codes(x[at], False)[:, None] ^ model.codes(x, True)[best])
        model.radius = int(min(bits, np.ceil(np.quantile(far, RECALL))))
    return model


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def best(model: Model, ids: np.ndarray, index: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query of a block the best ``k`` of an index block: (query row, id, score)."""
    codes = model.codes(index, True)
    probes = model.codes(queries, False)
    width = -(-model.bits // PARTS)
    low = np.uint64((1 << width) - 1)
    indexes = [np.unique(codes >> np.uint64(width * j) & low, return_inverse=True) for j in range(PARTS)]
    out_q, out_id, out_score = [], [], []
    always = giants(index, model.longest)
    step = max(1, 2_000_000 // max(1, len(ids)))
    for lo in range(0, len(probes), step):
        own = probes[lo : lo + step]
        near = np.zeros((len(own), len(ids)), bool)
        for j, ((values, place), radius) in enumerate(zip(indexes, model.part_radii())):
            if radius >= 0:
                near |= (np.bitwise_count((own >> np.uint64(width * j) & low)[:, None] ^ values) <= radius)[:, place]
        near &= np.bitwise_count(own[:, None] ^ codes) <= model.radius
        near |= always
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.where(near, np.nan_to_num(queries[lo : lo + step] @ index.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf), -np.inf)
        for q in range(len(own)):
            found = np.flatnonzero(near[q])
            if len(found) > k:
                line = scores[q, found]
                found = found[line >= np.partition(line, len(line) - k)[len(line) - k]]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (index[found] * queries[lo + q]).sum(axis=1)
            order = np.lexsort([ids[found], -exact])[:k]
            out_q.append(np.full(len(order), lo + q))
            out_id.append(ids[found[order]])
            out_score.append(exact[order])
    empty = np.zeros(0)
    return np.concatenate(out_q or [empty.astype(int)]), np.concatenate(out_id or [empty.astype(int)]), np.concatenate(out_score or [empty])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, key, score)``: for each row with ``is_query`` the ``k`` nearest found among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("m")).orderBy(F.desc("n"), "d").first()
    names = f"query_id long, rank int, `{key}` long, score double"
    if sizes is None:
        return spark.createDataFrame([], names)
    rows = rows.filter(F.size("v") == sizes["d"]).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(7919), "v"))
    share = min(1.0, sample_rows / sizes["n"])
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1.0)).dropDuplicates(["a", "b"]).select("id", "v").toPandas().sort_values("id")
    x = np.array(sample["v"].tolist(), np.float64)
    most, _, length = lengths(x) if len(x) else (np.ones((1, 1)), None, np.ones((1, 1)))
    usual = float(min(LONG * np.quantile(most, 0.999) * np.quantile(length, 0.999), np.finfo(float).max / LONG))
    longest = float(np.sqrt(sizes["m"]))
    model = spark.sparkContext.broadcast(learn(x, (min(longest, usual) if longest > 0 else usual) * (1 + 1e-12), k, sizes["n"]))

    # Of equal vectors the k + 1 smallest ids; the smallest stands for all.
    twins = Window.partitionBy("a", "b").orderBy("id")
    ranked = rows.select("a", "b", "id", "v").dropDuplicates(["a", "b", "id"]).withColumn("r", F.row_number().over(twins)).filter(F.col("r") <= k + 1)
    ranked = pin(ranked.select("a", "b", "r", "id", F.when(F.col("r") == 1, F.col("v")).alias("v")))
    stands = pin(ranked.filter("r = 1").select("a", "b", F.col("id").alias("rep"), "v"))
    twins_of = pin(ranked.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("rep")).select("rep", "ids"))
    asked = pin(rows.filter("q").select("id", "a", "b").distinct().join(stands.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "rep"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select(F.col("id").alias("query_id"), "rep"))
    once = pin(asked.select(F.col("rep").alias("_rep")).distinct())

    index_blocks = max(1, -(-stands.count() // INDEX_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def lists_of(once: DataFrame, everywhere: bool) -> DataFrame:
        """``(_rep, list)``: for each vector of ``once`` the best ``k + 1`` within the radius, or of all."""
        query_blocks = max(1, -(-once.count() // QUERY_BLOCK))
        stored = stands.select("rep", "v", block("rep", index_blocks).alias("i"), numbers(query_blocks).alias("j")).withColumn("side", F.lit(0))
        probing = stands.join(once, F.col("rep") == F.col("_rep"), "left_semi").select("rep", "v", numbers(index_blocks).alias("i"), block("rep", query_blocks).alias("j")).withColumn("side", F.lit(1))
        tasks = stored.unionByName(probing).select((F.col("i").cast("long") * query_blocks + F.col("j")).alias("task"), "side", "rep", "v")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = replace(model.value, radius=model.value.bits) if everywhere else model.value
            for table, cut in groups(batches):
                side, rep, x = table.column(1).to_numpy(), table.column(2).to_numpy(), matrix(table.column(3))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    s = np.flatnonzero(side[lo:hi] == 0) + lo
                    q = np.flatnonzero(side[lo:hi] == 1) + lo
                    if len(s) and len(q):
                        row, found, score = best(own, rep[s], x[s], x[q], k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(rep[q][row]), pa.array(found), pa.array(score)], names=["_rep", "found", "score"])

        near = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "_rep long, found long, score double")
        top = Window.partitionBy("_rep").orderBy(F.desc("score"), "found")
        near = near.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1)
        spread = near.join(twins_of, near["found"] == twins_of["rep"]).select("_rep", "score", F.explode("ids").alias("id"))
        spread = spread.withColumn("r", F.row_number().over(Window.partitionBy("_rep").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
        return pin(spread.groupBy("_rep").agg(F.sort_array(F.collect_list(F.struct(F.col("r"), "id", "score"))).alias("list")))

    lists = lists_of(once, False)
    # A query and its k neighbours, or all rows there are; queries with fewer, or with none, meet the whole index.
    full = min(k + 1, ranked.count())
    held = lists.filter(F.size("list") >= full)
    short = pin(once.join(held.select(F.col("_rep").alias("_held")), F.col("_rep") == F.col("_held"), "left_anti"))
    if not short.isEmpty():
        lists = held.unionByName(lists_of(short, True))
    answers = asked.join(lists, F.col("rep") == F.col("_rep")).select("query_id", F.slice(F.filter("list", lambda e: e["id"] != F.col("query_id")), 1, k).alias("list"))
    return answers.select("query_id", F.posexplode("list").alias("p", "e")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias(key), F.col("e.score").alias("score"))
