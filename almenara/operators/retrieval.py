"""Exact top-k search, lexical ranking and the evaluation of both.

Hits are ``query_id, rank, id, similarity``. Scores are compared at ``SCORE_DECIMALS`` decimals, so
equal vectors tie whatever the order of summation, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almenara.functions.numeric import pct, rounded, true
from almenara.operators.lexical import SCORE_DECIMALS, bm25_search  # noqa: F401  lexical and vector search side by side
from almenara.operators.ordered import top_n
from almenara.session import pin
from almenara.settings import RETRIEVAL

CELLS = 2_000_000
QUERY_ROWS = 1024
#: What the vectors of a block may take; a task holds one block at a time (and a reordered copy of it).
BLOCK_BYTES = 32 << 20
#: Angles are compared with this much room, so rounding never leaves a row out.
ROOM = 1e-6
#: What the vectors of queries may take to be handed to every task; more of them meet the corpus in blocks.
QUERY_BYTES = 64 << 20
#: Rows that may lead and wait for their turn to be sorted.
CANDIDATES = 4096


# ---------------------------------------------------------------- search
def _matrix(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 1)


def _units(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, and which of them have a direction at all."""
    m = _matrix(rows)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.clip(norm, 1e-300, None), np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)


class Block:
    """Vectors of a block in clusters with a radius; a query skips clusters that cannot hold one of its k best.

    A cluster is a direction and the largest angle of its members from it. By the triangle inequality no member is
    nearer to a query than the query's angle to that direction less the radius. Vectors without a direction (zero or not
    finite) form a cluster that is never skipped.
    """

    def __init__(self, ids: np.ndarray, vectors: pa.Array, scope: np.ndarray | None = None) -> None:
        unit, sound = _units(vectors)
        n = len(unit)
        self.scored = 0
        sample = unit[sound][:: max(1, int(np.sqrt(sound.sum())))] if sound.any() else unit[:0]
        self.centre, label = sample, np.full(n, len(sample))
        for _ in range(2 if len(sample) else 0):
            label[sound] = np.concatenate([(unit[sound][i : i + 4096] @ self.centre.T).argmax(axis=1) for i in range(0, int(sound.sum()), 4096)])
            total = np.zeros_like(self.centre)
            np.add.at(total, label[sound], unit[sound])
            size = np.linalg.norm(total, axis=1, keepdims=True)
            self.centre = np.where(size > 0, total / np.clip(size, 1e-300, None), self.centre)
        order = np.argsort(label, kind="stable")
        self.unit, self.ids, self.scope = unit[order], ids[order], None if scope is None else scope[order]
        self.at = np.searchsorted(label[order], np.arange(len(self.centre) + 2))
        near = np.einsum("ij,ij->i", self.unit[: self.at[-2]], self.centre[label[order][: self.at[-2]]])
        held = np.flatnonzero(np.diff(self.at[:-1]))
        self.radius = np.zeros(len(self.centre))
        if len(held):
            self.radius[held] = np.arccos(np.clip(np.minimum.reduceat(near, self.at[held]), -1, 1))

    def most(self, queries: np.ndarray, sound: np.ndarray) -> np.ndarray:
        """The largest cosine a member of each cluster can have with each query: (clusters + 1, queries)."""
        angle = np.arccos(np.clip(self.centre @ queries.T, -1, 1)) - self.radius[:, None] - ROOM
        bound = np.vstack([np.cos(np.clip(angle, 0, np.pi)), np.ones(len(queries))])
        bound[:, ~sound] = np.inf
        return bound

    def search(self, queries: np.ndarray, sound: np.ndarray, wanted: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and similarity of the k best rows of each query, ties by id."""
        bound, m = self.most(queries, sound), len(queries)
        bar = np.full(m, -np.inf)
        held = (np.zeros(0, np.int64), self.ids[:0], np.zeros(0))
        todo = np.ones(bound.shape, bool)
        # First every query's most promising cluster, then all that are still open.
        first = bound.argmax(axis=0)
        turns = [(c, first == c) for c in np.unique(first).tolist()] + [(c, True) for c in np.argsort(-bound.max(axis=1), kind="stable").tolist()]
        for c, asking in turns:
            who = np.flatnonzero(asking & todo[c] & (bound[c] >= bar - ROOM))
            lo, hi = self.at[c], self.at[c + 1]
            todo[c, who] = False
            if lo == hi or not len(who):
                continue
            step = max(1, CELLS // len(who))
            for a in range(lo, hi, step):
                held = self._take(held, bar, queries, who, wanted, a, min(a + step, hi), k)
        return held

    def _take(self, held: tuple, bar: np.ndarray, queries: np.ndarray, who: np.ndarray, wanted: np.ndarray | None, lo: int, hi: int, k: int) -> tuple:
        """Score rows lo to hi for the queries ``who`` and keep the k best of each; ``bar`` is raised."""
        scores = np.round(self.unit[lo:hi] @ queries[who].T, SCORE_DECIMALS)
        self.scored += scores.size
        if wanted is not None:
            scores[self.scope[lo:hi, None] != wanted[None, who]] = -np.inf
        row, column = np.nonzero((scores >= bar[who]) & np.isfinite(scores))
        if not len(row):
            return held
        return _best(held, bar, who[column], self.ids[lo + row], scores[row, column], k)


def _best(held: tuple, bar: np.ndarray, query: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple:
    """The k best of each query among ``held`` (query, id, similarity) and new rows; ``bar`` is raised to the k-th similarity."""
    query, ids, s = np.concatenate([held[0], query]), np.concatenate([held[1], ids]), np.concatenate([held[2], s])
    order = np.lexsort((ids, -s, query))
    query, ids, s = query[order], ids[order], s[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < k
    last = place == k - 1
    bar[query[last]] = s[last]
    return query[kept], ids[kept], s[kept]


class Leaders:
    """The k best of all rows seen for each of the queries; vectors are dropped once they are scored.

    A similarity is a product over both lengths: where vectors are whole numbers, the order of summation does not show."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.norm, self.k = queries.T, np.linalg.norm(queries, axis=1), k
        self.bar = np.full(len(queries), -np.inf)
        self.held: tuple | None = None
        self.waiting: list[tuple] = []

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        names, step = ids.to_numpy(zero_copy_only=False), max(1, CELLS // max(1, len(self.norm)))
        for lo in range(0, len(vectors), step):
            some = vectors[lo : lo + step]
            norm = np.linalg.norm(some, axis=1)[:, None] * self.norm
            scores = np.round((some @ self.queries) / np.where(norm > 0, norm, 1.0), SCORE_DECIMALS)
            row, query = np.nonzero((scores >= self.bar) & np.isfinite(scores))
            if len(row):
                self.waiting.append((query, names[lo + row], scores[row, query]))
            if sum(len(w[0]) for w in self.waiting) > CANDIDATES:
                self.settle()

    def settle(self) -> tuple:
        """Query number, id and similarity of the leaders; ties by id."""
        if self.waiting:
            parts = [*([self.held] if self.held else []), *self.waiting]
            query, ids, s = (np.concatenate([part[i] for part in parts]) for i in range(3))
            self.held, self.waiting = _best((query[:0], ids[:0], s[:0]), self.bar, query, ids, s, self.k), []
        return self.held or (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))


def _blocks(size: Column) -> Column:
    return F.greatest(F.coalesce(F.ceil(size * 2 / BLOCK_BYTES), F.lit(1)), F.lit(1)).cast("int").alias("n")


def blocks_for(rows: DataFrame, vectors: Column, slots: int) -> Column:
    """Number of blocks for as many vectors of ``slots`` numbers as ``vectors``, an aggregate over ``rows``, tells.

    A search whose vectors are made on the way then makes them once, not a second time to add up their bytes."""
    return rows.select(_blocks(vectors * (slots * 8 + 64))).scalar()


def search(
    corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", scope: str | None = None, blocks: int | Column | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query over the whole corpus, for any number of queries.

    ``corpus`` has ``id`` and ``queries`` has ``query_id`` beside the vector. The corpus is dealt to blocks whose number
    follows from its bytes, so that a block has ``BLOCK_BYTES`` at most (half of it on average, as rows are dealt by
    hash); every query visits every block. A task holds one block, in clusters, and lets the queries pass in Arrow
    batches; a step of the product never holds more than ``CELLS`` scores, and k rows per query and block go on.
    Nothing runs before the result is asked for: the number of blocks is a subquery of the plan, here or of :func:`blocks_for`.
    """
    id_type, query_type = corpus.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("similarity", T.DoubleType()),
    ])
    size = F.sum(F.size(vector).cast("long") * 8 + 64)
    n = corpus.select(_blocks(size)).scalar() if blocks is None else blocks if isinstance(blocks, Column) else F.lit(blocks)
    own = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both sides may share a source
    left = corpus.select(F.pmod(F.xxhash64("id"), n).cast("int").alias("_b"), F.struct(*corpus.columns).alias("_c"))
    right = own.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("_b"), F.struct(*own.columns).alias("_q"))
    both = left.withColumn("_q", F.lit(None).cast(right.schema["_q"].dataType)).unionByName(right.withColumn("_c", F.lit(None).cast(left.schema["_c"].dataType)))
    dealt = both.withColumn("_side", F.col("_q").isNotNull().cast("int")).select("_b", "_side", "_c", "_q")

    def column(parts: list[pa.Array], name: str) -> pa.Array:
        return pa.concat_arrays([part.field(name) for part in parts])

    def values(parts: list[pa.Array], name: str) -> np.ndarray:
        return column(parts, name).to_numpy(zero_copy_only=False)

    def meet(block: Block, asked: pa.Array) -> Iterator[pa.RecordBatch]:
        unit, sound = _units(asked.field(vector))
        query, ids, s = block.search(unit, sound, values([asked], scope) if scope else None, k)
        names = asked.field("query_id").take(pa.array(query))
        if len(query):
            yield pa.RecordBatch.from_arrays([names, pa.array(ids, names.type if id_type == query_type else None), pa.array(s)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, stored, block = None, [], None
        for rb in batches:
            place, side = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
                if lo == hi:
                    continue
                if place[lo] != number:
                    number, stored, block = place[lo], [], None
                if side[lo] == 0:
                    stored.append(rb.column(2).slice(lo, hi - lo))
                    continue
                if stored:
                    block = Block(values(stored, "id"), column(stored, vector), values(stored, scope) if scope else None)
                    stored = []
                for at in range(lo, hi, QUERY_ROWS) if block else ():
                    yield from meet(block, rb.column(3).slice(at, min(QUERY_ROWS, hi - at)))

    partial = dealt.repartition("_b").sortWithinPartitions("_b", "_side").mapInArrow(run, schema)
    order = [F.desc("similarity"), F.asc("id")]
    return top_n(partial, ["query_id"], order, k, spread=["id"]).select("query_id", "rank", "id", "similarity")


def semantic_search(
    corpus: DataFrame, queries: DataFrame, k: int = RETRIEVAL.top_k, vector: str = "embedding",
    scope: str | None = None, **kw,
) -> DataFrame:
    """Exact cosine top-k; with ``scope`` a query only meets rows that share its value there.

    A structured filter is applied by filtering ``corpus`` first, so k rows come back whenever k
    rows satisfy it.
    """
    extra = [scope] if scope else []
    return search(
        corpus.filter(F.col(vector).isNotNull()).select("id", vector, *extra),
        queries.filter(F.col(vector).isNotNull()).select("query_id", vector, *extra), k, vector, scope, **kw,
    )


def search_texts(
    corpus: DataFrame, queries: DataFrame, k: int, encoder: Callable[[], Callable[[pa.Array], Iterator[np.ndarray]]], scope: str | None = None, total: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Exact cosine top-k of every query in every scope, over texts whose vectors are made, scored and dropped by the task that reads them.

    ``corpus`` has ``id, text`` and the named columns, ``queries`` has ``query_id, embedding``. The queries go to all tasks, so they must
    be as few as :func:`few` says; a task keeps k rows of each query and scope, there are few scopes. No vector is shuffled
    or stored. Returned are the hits (with the scope) and, from the same pass, the number of rows (``n``) and the sum of ``total`` by scope.
    """
    id_type, query_type = corpus.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType([
        T.StructField("scope", T.IntegerType() if scope is None else corpus.schema[scope].dataType), T.StructField("query_id", query_type),
        T.StructField("id", id_type), T.StructField("similarity", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()),
    ])
    asked = queries.select("query_id", "embedding").toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), _matrix(asked.column("embedding").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (names, vectors) = encoder(), shared.value
        leaders: dict = {}
        sums: dict = {}
        kind: list[pa.DataType] = []
        for rb in batches:
            kind = [rb.column("scope").type, names.type, rb.column("id").type, pa.float64(), pa.int64(), pa.int64()]
            for value in rb.column("scope").unique():
                known = value.as_py()
                mine = rb.filter(pc.is_null(rb.column("scope")) if known is None else pc.equal(rb.column("scope"), value))
                lead, (n, added) = leaders.setdefault(known, Leaders(vectors, k)), sums.get(known, (0, 0))
                sums[known] = n + len(mine), added + (pc.sum(mine.column("total")).as_py() or 0)
                at = 0
                for counted in encode(mine.column("text")) if len(vectors) else ():
                    lead.add(mine.column("id").slice(at, len(counted)), counted)
                    at += len(counted)
        for value, lead in leaders.items():
            query, ids, s = lead.settle()
            m, (n, added) = len(query), sums[value]
            for columns in (
                ([value] * m, names.take(pa.array(query)), ids, s, [None] * m, [None] * m),
                ([value], [None], [None], [None], [n], [added]),
            ):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kind)], names=schema.names)

    read = corpus.select(
        (F.lit(0) if scope is None else F.col(scope)).alias("scope"), "id", "text", (F.lit(None) if total is None else F.col(total)).cast("long").alias("total"),
    )
    partial = pin(read.mapInArrow(run, schema))
    by = ["query_id"] if scope is None else ["query_id", scope]
    found = partial.filter(F.col("n").isNull()).select("query_id", "id", "similarity", *([] if scope is None else [F.col("scope").alias(scope)]))
    hits = top_n(found, by, [F.desc("similarity"), F.asc("id")], k, spread=["id"]).select(*by, "rank", "id", "similarity")
    sums = partial.filter(F.col("n").isNotNull()).groupBy(F.col("scope").alias(scope or "scope")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return hits, sums


def few(queries: DataFrame, slots: int) -> bool:
    """Whether the vectors of ``queries`` may go to every task."""
    return queries.count() * slots * 8 <= QUERY_BYTES


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two array columns inside the JVM, for pairs that already share a row."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


# ---------------------------------------------------------------- relevance
def page_set(cell: Column) -> Column:
    """``3;4,5`` as an array of integers; parts that are not numbers are ignored."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "[;,]"), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int")))


def on_expected_page(doc: Column, page: Column, want_doc: Column, want_pages: Column, tolerance: int = RETRIEVAL.page_tolerance) -> Column:
    """The expected document, at most ``tolerance`` pages from an expected page."""
    return true((doc == want_doc) & F.exists(want_pages, lambda p: F.abs(p - page) <= tolerance))


def gold_by_pattern(
    rows: DataFrame, themes: dict[str, str], key: str, text: Column, min_matches: int = 3
) -> DataFrame:
    """Themes defined by a regular expression: one row per theme and matching id, and how many match.

    Rows are tested once for all themes; a theme with fewer than ``min_matches`` is dropped. A theme may match most
    rows, so its ids are never gathered in one row; the counts, one row per theme, are joined to the matches.
    """
    lowered = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(lowered.rlike(p), F.lit(name)) for name, p in themes.items()]))
    matched = rows.select(F.col(key), F.explode(hits).alias("theme"))
    counts = matched.groupBy("theme").agg(F.count("*").alias("relevant")).filter(F.col("relevant") >= min_matches)
    return matched.join(counts, "theme")


def first_hit(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Best similarity, abstention input and rank of the first relevant hit of each query.

    ``queries`` has ``query_id, kind``; ``hits`` adds ``relevant``. A query without hits has
    similarity 0.
    """
    per_query = hits.groupBy("query_id").agg(
        F.max("similarity").alias("_s"), F.min(F.when(true("relevant"), F.col("rank"))).alias("first_rank")
    )
    in_domain = F.col("kind") == "in_domain"
    return queries.join(per_query, "query_id", "left").withColumns({
        "top_similarity": F.coalesce("_s", F.lit(0.0)),
        "first_rank": F.when(in_domain, F.col("first_rank")),
    }).drop("_s")


# ---------------------------------------------------------------- evaluation
def retrieval_scores(
    ranked: DataFrame, threshold: float = RETRIEVAL.threshold, ks: tuple[int, ...] = RETRIEVAL.ks
) -> DataFrame:
    """Recall@k and abstention counts, one row; ``ranked`` comes from :func:`first_hit`."""
    is_in, s = F.col("kind") == "in_domain", F.col("top_similarity")
    quiet = s < threshold
    n_in, n_out = F.count_if(is_in), F.count_if(~is_in)
    right, wrong = F.count_if(~is_in & quiet), F.count_if(is_in & quiet)

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(rounded(F.try_divide(a, b), 4), F.lit(0.0))

    def part(fn, cond: Column) -> Column:
        return F.coalesce(rounded(fn(F.when(cond, s)), 4), F.lit(0.0))

    return ranked.agg(
        n_in.alias("in_domain"), n_out.alias("out_domain"),
        part(F.avg, is_in).alias("mean_similarity_in"), part(F.avg, ~is_in).alias("mean_similarity_out"),
        part(F.max, ~is_in).alias("max_similarity_out"), right.alias("right_abstentions"),
        wrong.alias("wrong_abstentions"), rate(right, n_out).alias("right_abstention_rate"),
        rate(wrong, n_in).alias("wrong_abstention_rate"),
        *[rate(F.count_if(is_in & true(F.col("first_rank") <= k)), n_in).alias(f"recall_at_{k}") for k in ks],
    )


def threshold_sweep(ranked: DataFrame, thresholds: tuple[float, ...] = RETRIEVAL.threshold_sweep) -> DataFrame:
    """Right decisions per threshold, all thresholds from one pass over the ranked queries."""
    is_in, s = F.col("kind") == "in_domain", F.col("top_similarity")
    rows = [
        F.struct(
            F.lit(float(u)).alias("threshold"), F.count_if(~is_in & (s < u)).alias("right_abstentions"),
            F.count_if(is_in & (s < u)).alias("wrong_abstentions"),
            F.count_if((is_in & (s >= u)) | (~is_in & (s < u))).alias("right_total"),
            pct(F.count_if((is_in & (s >= u)) | (~is_in & (s < u))), F.count("*"), 1).alias("pct_right"),
        ) for u in thresholds
    ]
    return ranked.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold among those with most right decisions."""
    return sweep.agg(F.max_by("threshold", F.struct(F.col("right_total"), -F.col("threshold"))).alias("threshold"))


def top_similarity(hits: DataFrame, out: str) -> DataFrame:
    return hits.groupBy("query_id").agg(F.max("similarity").alias(out))


def control_experiment(queries: DataFrame, main: DataFrame, control: DataFrame) -> DataFrame:
    """Best similarity of each query in two corpora and the difference."""
    out = queries.join(top_similarity(main, "in_main"), "query_id", "left").join(
        top_similarity(control, "in_control"), "query_id", "left"
    )
    a, b = F.coalesce("in_main", F.lit(0.0)), F.coalesce("in_control", F.lit(0.0))
    return out.withColumns({"in_main": rounded(a, 4), "in_control": rounded(b, 4), "delta": rounded(b - a, 4)})


def control_margins(experiment: DataFrame, margins: tuple[float, ...] = (0.0, 0.01, 0.02, 0.05)) -> DataFrame:
    """Out-of-domain queries the control would catch, and valid ones it would reject, per margin."""
    is_in, d = F.col("kind") == "in_domain", F.col("delta")
    rows = [
        F.struct(F.lit(float(m)).alias("margin"), F.count_if(~is_in & (d > m)).alias("detected"),
                 F.count_if(is_in & (d > m)).alias("false_positives")) for m in margins
    ]
    return experiment.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def compare_rankings(queries: DataFrame, lexical: DataFrame, semantic: DataFrame, within: int = 3) -> DataFrame:
    """In-domain queries with a relevant hit in the first ``within``, per style, for two rankings."""
    a = first_hit(queries, lexical).select("query_id", "style", "kind", F.col("first_rank").alias("lexical_rank"))
    b = first_hit(queries, semantic).select("query_id", F.col("first_rank").alias("semantic_rank"))
    both = a.join(b, "query_id").filter(F.col("kind") == "in_domain")
    return both.groupBy("style").agg(
        F.count("*").alias("queries"),
        *[pct(F.count_if(true(F.col(f"{x}_rank") <= within)), F.count("*"), 1).alias(f"pct_{x}") for x in ("lexical", "semantic")],
    )


def filter_effect(queries: DataFrame, as_text: DataFrame, as_filter: DataFrame, wanted: str) -> DataFrame:
    """Share of hits with the wanted value when it is part of the query and when it is a filter.

    Both hit tables carry the value of the hit in ``value``.
    """
    def counted(hits: DataFrame, name: str) -> DataFrame:
        ok = F.count_if(F.col("value") == F.col(wanted))
        return hits.join(queries.select("query_id", wanted), "query_id").groupBy(wanted).agg(
            F.count("*").alias(f"retrieved_{name}"), ok.alias(f"match_{name}"), pct(ok, F.count("*"), 1).alias(f"pct_{name}")
        )

    return counted(as_text, "text").join(counted(as_filter, "filter"), wanted, "full")


# ---------------------------------------------------------------- answering
LOW_SIMILARITY, NOTHING_FOUND, ANSWER = "similitud baja", "sin resultados", "responder"


def decide(queries: DataFrame, hits: DataFrame, threshold: float = RETRIEVAL.threshold) -> DataFrame:
    """Whether to answer each query, and why not; the costly model call comes after this gate."""
    best = top_similarity(hits, "top_similarity")
    s = F.col("top_similarity")
    return queries.join(best, "query_id", "left").withColumn(
        "decision", F.when(s.isNull(), NOTHING_FOUND).when(s < threshold, LOW_SIMILARITY).otherwise(ANSWER)
    ).withColumn("abstains", F.col("decision") != ANSWER)


def context_blocks(hits: DataFrame) -> DataFrame:
    """One labelled text per query from its ranked fragments: ``doc, page, amends, text``."""
    label = F.concat(
        F.lit("--- Fragmento "), F.col("rank").cast("string"), F.lit(" · ["), F.col("doc").cast("string"), F.lit(", p. "),
        F.col("page").cast("string"), F.lit("]"), F.when(true("amends"), " (NORMA MODIFICATORIA)").otherwise(""),
        F.lit(" · similitud "), F.format_string("%.3f", rounded(F.col("similarity"), 3)), F.lit(" ---\n"), F.col("text"),
    )
    ranked = hits.select("query_id", F.struct("rank", label.alias("block")).alias("b"))
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b")).select(
        "query_id", F.array_join("b.block", "\n\n").alias("context")
    )


def amendment_notes(hits: DataFrame, first: int = 3) -> DataFrame:
    """Queries for which one of the first sources amends another norm."""
    return hits.groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.when(F.col("rank") <= first, F.col("amends"))), F.lit(False)).alias("needs_note")
    )


_ANSWER = "puede_responder BOOLEAN, respuesta STRING, citas ARRAY<STRING>, motivo STRING"


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Model output as ``answer, abstains, reason``; text that is no JSON object is the answer itself."""
    c = F.col(raw)
    is_object = true(F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull())
    parsed = df.withColumn("_j", F.when(is_object, F.from_json(c, _ANSWER)))
    able = F.coalesce("_j.puede_responder", F.lit(True))
    text = F.trim(F.coalesce("_j.respuesta", F.lit("")))
    cited = F.filter(F.transform("_j.citas", lambda x: F.trim(x)), lambda x: x != "")
    mark = F.array_join(F.transform(cited, lambda x: F.concat(F.lit("["), x, F.lit("]"))), "  ")
    add = able & true(mark != "") & ~true(F.contains(text, mark))
    answer = F.when(add, F.concat(text, F.lit("\n\nFuentes citadas: "), mark)).otherwise(text)
    return parsed.withColumns({
        "answer": F.when(is_object, answer).otherwise(c), "abstains": is_object & ~able,
        "reason": F.when(is_object, F.trim(F.coalesce("_j.motivo", F.lit("")))).otherwise(""),
    }).drop("_j")
