"""Okapi BM25 over postings: a table term -> (document, impact, block) that is joined with the terms of the queries.

Only documents that share a term with a query meet it, and most of those are never scored in full:

1. A query's terms are taken from the rarest on until they carry half of what it can reach. Their postings give
   partial scores. The documents that lead are scored in full; the k-th of them is a bar that the final k-th score
   cannot be below.
2. From the commonest term on, terms that together stay below the bar cannot lift a document over it alone. Documents
   are candidates only through the other terms.
3. A candidate that stays below the bar even with the largest impacts of those common terms in its block of documents
   is left out. The rest get their full scores.

Hits are ``query_id, rank, id, similarity``; scores are compared at ``SCORE_DECIMALS`` decimals and ties go to the
smaller id. A query that fewer than k documents share a term with is filled up with documents of score 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from almenara.functions.text import BLANKS, byte_words, stretches, words
from almenara.operators.ordered import top_n
from almenara.session import pin
from almenara.settings import RETRIEVAL

SCORE_DECIMALS = 6
#: Sums are compared with this much room, so rounding never leaves a document out.
ROOM = 1e-5
#: Terms of all queries, and terms of queries, are broadcast up to these numbers; beyond, Spark joins by shuffle.
BROADCAST_TERMS = 500_000
#: So many times k documents are scored in full to set a query's bar.
LEAD = 20


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def _distinct(texts: pa.Array, asked: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of lower-case texts, and for each distinct (``asked``) term of a text: the text, the term's place among the terms and how often
    it occurs. Each text begins with an entry without a term (place -1) that has the number of all its words."""
    found, of_text = byte_words(texts, BLANKS)
    coded = found.dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    size = len(terms) + 1
    text = np.arange(len(texts), dtype=np.int64) * size
    code = coded.indices.to_numpy() + 1
    keys = np.repeat(text, of_text) + code
    if asked is not None:
        keep = pc.is_in(terms, value_set=asked).to_numpy(zero_copy_only=False)
        keys = keys[keep[code - 1]]
    keys = np.sort(np.concatenate([text, keys]))
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    tf = np.diff(at, append=len(keys))
    of, place = np.divmod(keys[at], size)
    tf[place == 0] = of_text
    return terms, of, place - 1, tf


def _counts(asked: Broadcast | None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for texts in batches for part in stretches(texts)):
            terms, of, place, tf = _distinct(part, None if asked is None else asked.value)
            entries = pa.StructArray.from_arrays([terms.take(pa.array(place, mask=place < 0)), pa.array(tf, pa.int64())], ["term", "tf"])
            starts = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(starts), entries, mask=part.is_null())

    return run


def counted_documents(corpus: DataFrame, asked: Broadcast | None = None, text: str = "text") -> DataFrame:
    """``id, length, counts``: the distinct (``asked``) terms of a document, counted in the task that reads it, in Arrow stretches.

    The first of the counts has no term and stands for the document itself.
    """
    counts = arrow_udf(_counts(asked), "array<struct<term: string, tf: bigint>>")(F.lower(text))
    return corpus.select("id", counts.alias("counts")).select("id", F.col("counts")[0]["tf"].alias("length"), "counts")


def entries(docs: DataFrame) -> DataFrame:
    """``id, length, term, tf``; outer, as a filter would count the words again."""
    return docs.select("id", "length", F.inline_outer("counts"))


def term_counts(corpus: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``id, length, term, tf`` of the given terms (column ``term``, each once; the NULL term for the documents themselves)."""
    wanted = terms.select(F.col("term").alias("_t"))
    return entries(counted_documents(corpus, text=text)).join(wanted, F.col("term").eqNullSafe(F.col("_t")), "left_semi")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in stretches(batch.column(0))):
        terms, _, place, _ = _distinct(part)
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(place[place >= 0], minlength=len(terms)))], ["term", "df"])


def vocabulary(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``term, df`` of all terms of the corpus; a stretch of texts is added up where it is read."""
    return corpus.select(F.lower(text).alias("t")).mapInArrow(_vocabulary, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def asked_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(words(F.lower(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeats"))


def and_documents(terms: DataFrame) -> DataFrame:
    """The distinct terms and the NULL term."""
    return terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit(None).cast("string").alias("term")))


def weigh(corpus: DataFrame, asked: DataFrame, counted: DataFrame, text: str = "text", epsilon: float = RETRIEVAL.bm25_epsilon) -> DataFrame:
    """:func:`term_weights` of ``asked`` terms whose counts and documents are in ``counted``.

    The mean idf of all terms of the corpus is taken only when an asked term is in over half of the documents: no other weight needs it.
    """
    frequency = pin(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length")))
    whole = frequency.filter(F.col("term").isNull())
    total = whole.select("df").scalar()

    def with_idf(df: DataFrame) -> DataFrame:
        return df.filter(F.col("term").isNotNull()).select("term", "df", (F.ln(total - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))

    weighted = with_idf(frequency)
    floor = F.lit(None).cast("double")
    if not weighted.filter("idf < 0").isEmpty():
        floor = F.lit(with_idf(vocabulary(corpus, text)).agg(F.avg("idf")).first()[0] * epsilon)
    final = F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")) * F.col("repeats")
    return asked.join(weighted, "term").select(
        "query_id", "term", final.alias("weight"), "df", whole.select(F.col("length") / F.col("df")).scalar().alias("mean_length")
    )


def term_weights(corpus: DataFrame, queries: DataFrame, text: str = "text", epsilon: float = RETRIEVAL.bm25_epsilon) -> DataFrame:
    """``query_id, term, weight, df, mean_length``; a term in over half of the documents gets ``epsilon`` x mean idf.

    Terms that no document holds are left out.
    """
    asked = asked_terms(queries, text)
    return weigh(corpus, asked, pin(term_counts(corpus, and_documents(asked), text)), text, epsilon)


def impacts(counted: DataFrame, mean_length: float, blocks: int, k1: float = RETRIEVAL.bm25_k1, b: float = RETRIEVAL.bm25_b) -> DataFrame:
    norm = F.lit(1 - b) + F.lit(b / (mean_length or 1.0)) * F.col("length")
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return counted.filter(F.col("term").isNotNull()).select("term", "id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), impact.alias("impact"))


def postings(corpus: DataFrame, terms: DataFrame, mean_length: float, blocks: int, text: str = "text", k1: float = RETRIEVAL.bm25_k1, b: float = RETRIEVAL.bm25_b) -> DataFrame:
    """``term, id, block, impact`` of the given terms (column ``term``, each once); ``block`` is one of ``blocks`` groups of documents."""
    return impacts(term_counts(corpus, terms, text), mean_length, blocks, k1, b)


def reach(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked`` with ``most``, what a term can add to a score, and ``early``: the rare half that is looked up first.

    A query with a negative weight (a tiny corpus) is looked up in full.
    """
    most = held.groupBy("term").agg(F.max("impact").alias("top"))
    known = asked.join(most, "term").withColumn("most", F.col("weight") * F.col("top"))
    query = Window.partitionBy("query_id")
    rarest = query.orderBy("df", "term")
    before = F.sum("most").over(rarest) - F.col("most")
    return known.withColumn("early", (F.min("weight").over(query) < 0) | (before < F.sum("most").over(query) / 2))


def lookup(held: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """What each posting adds to each query that holds its term."""
    wanted = small(terms.select("query_id", "term", "weight"), rows)
    return held.join(wanted, "term").select("query_id", "id", "block", (F.col("weight") * F.col("impact")).alias("score"))


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "id", "block").agg(F.sum("score").alias("score"))


def full(held: DataFrame, rows: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """``query_id, id, score`` of all ``terms`` of the queries for the given (query_id, id) rows; only these meet postings."""
    wanted = held.join(small(terms.select("term").distinct(), n), "term", "left_semi").select("term", "id", "impact")
    return rows.select("query_id", "id").join(wanted, "id").join(small(terms.select("query_id", "term", "weight"), n), ["query_id", "term"]).select(
        "query_id", "id", (F.col("weight") * F.col("impact")).alias("score")
    )


def bars(held: DataFrame, plan: DataFrame, early: DataFrame, rows: int, k: int) -> DataFrame:
    """The k-th largest full score among the documents that lead after the rare half, of each query that has k."""
    lead = top_n(early, ["query_id"], [F.desc("score"), F.asc("id")], LEAD * k, spread=["id"])
    scored = full(held, lead, plan, rows).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    best = top_n(scored, ["query_id"], [F.desc("score"), F.asc("id")], k, spread=["id"])
    return best.filter(F.col("rank") == k).select("query_id", (F.col("score") - ROOM).alias("bar"))


def candidates(held: DataFrame, plan: DataFrame, rows: int, k: int, tops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that may be among the k best, with what they have so far, and the terms still to be looked up for them.

    ``tops`` has the largest impacts by term and block, if they are known."""
    early = pin(added(lookup(held, plan.filter("early"), rows)))
    bar = pin(bars(held, plan, early, rows, k))
    commonest = Window.partitionBy("query_id").orderBy(F.desc("df"), "term")
    rest = plan.filter("not early").join(bar, "query_id", "left").withColumn("late", F.coalesce(F.sum("most").over(commonest) < F.col("bar"), F.lit(False)))
    partial = added(early.unionByName(lookup(held, rest.filter("not late"), rows)))
    late = rest.filter("late").select("query_id", "term", "weight", "df")
    top = (held if tops is None else tops).groupBy("term", "block").agg(F.max("impact").alias("top"))
    lift = top.join(small(late, rows), "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("lift"))
    open_ = partial.join(lift, ["query_id", "block"], "left").join(small(bar, rows), "query_id", "left")
    may = F.col("bar").isNull() | (F.col("score") + F.coalesce("lift", F.lit(0.0)) >= F.col("bar"))
    return open_.filter(may).select("query_id", "id", "score"), late


def filled(hits: DataFrame, known: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``hits`` and, for queries with fewer than k ``known`` rows of score 0 or more, documents of score 0.

    The smallest ids that a query has no hit for are among as many ids as it has hits, and k more.
    """
    counts = queries.select("query_id").distinct().join(known.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0).alias("up")), "query_id", "left")
    short = pin(counts.filter(F.coalesce("up", F.lit(0)) < k).select("query_id", F.coalesce("n", F.lit(0)).alias("n")))
    most = short.agg(F.max("n")).first()[0]
    if most is None:
        return hits
    ids = [r[0] for r in corpus.select("id").filter(F.col("id").isNotNull()).distinct().orderBy("id").limit(most + k).collect()]
    zero = short.select("query_id", F.explode(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<long>")).alias("id"))
    return hits.unionByName(zero.join(known, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0)))


def bm25_search(
    corpus: DataFrame, queries: DataFrame, k: int = RETRIEVAL.top_k, text: str = "text",
    k1: float = RETRIEVAL.bm25_k1, b: float = RETRIEVAL.bm25_b, epsilon: float = RETRIEVAL.bm25_epsilon, blocks: int | None = None,
) -> DataFrame:
    """The k best documents of each query over lower-case white-space tokens; ``corpus`` has one row per ``id``."""
    blocks = blocks or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = pin(asked_terms(queries, text))
    if wanted.count() <= BROADCAST_TERMS:
        known = corpus.sparkSession.sparkContext.broadcast(wanted.select("term").distinct().toArrow().column("term").combine_chunks())
        counted = entries(pin(counted_documents(corpus, known, text)))
    else:
        counted = pin(term_counts(corpus, and_documents(wanted), text))
    asked = pin(weigh(corpus, wanted, counted, text, epsilon))
    rows, mean_length, least = asked.agg(F.count("*"), F.max("mean_length"), F.min("weight")).first()
    held = impacts(counted, mean_length or 1.0, blocks, k1, b)
    tops = pin(held.groupBy("term", "block").agg(F.max("impact").alias("impact")))
    plan = pin(reach(asked, tops))
    open_, late = candidates(held, plan, rows, k, tops)
    open_ = pin(open_)
    scored = open_.unionByName(full(held, open_, late, rows)).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    # Without negative weights every candidate has a score of 0 or more, so candidates tell which queries are short of k.
    known = open_
    if (least or 0.0) < 0:
        scored = known = pin(scored)
    hits = filled(scored, known, corpus, queries, k)
    rounded: Column = F.round("score", SCORE_DECIMALS)
    return top_n(hits.select("query_id", "id", rounded.alias("similarity")), ["query_id"], [F.desc("similarity"), F.asc("id")], k, spread=["id"]).select("query_id", "rank", "id", "similarity")
