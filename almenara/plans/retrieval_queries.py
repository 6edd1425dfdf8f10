"""Queries on search, ranking and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.operators import documents as docs
from almenara.operators import index, lexical
from almenara.operators import retrieval as ops
from almenara.plans.document_queries import _FIXED, hashed_sql
from almenara.plans.oracle_text import pct, rnd
from almenara.plans.registry import query
from almenara.session import pin, scratch
from almenara.settings import CHUNK_SWEEP


def _corpus(t):
    return t.retrieval.filter(~F.col("is_query")).select(F.col("vec_id").alias("id"), "label", "embedding")


def _queries(t):
    return t.retrieval.filter("is_query").select(F.col("vec_id").alias("query_id"), "label", "kind", "style", "embedding")


def _hits(t, k=10):
    """Hits with the relevance rule of the evaluation sets: same label."""
    hits = ops.semantic_search(_corpus(t), _queries(t), k)
    labels = _corpus(t).select("id", F.col("label").alias("value"))
    wanted = _queries(t).select("query_id", F.col("label").alias("want"))
    return hits.join(labels, "id").join(wanted, "query_id").withColumn(
        "relevant", F.col("value") == F.col("want")
    ).drop("want")


def _search_sql(k: int, name: str = "hi", where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS value, c.label = q.label AS relevant,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS INTEGER) AS rank
  FROM retrieval q, retrieval c WHERE q.is_query AND NOT c.is_query AND {where}) z WHERE rank <= {k})"""


_QS = "qs AS (SELECT vec_id AS query_id, label, kind, style FROM retrieval WHERE is_query)"


@query("semantic_search", ("retrieval",), f", {_search_sql(10)} SELECT query_id, rank, id, similarity FROM hi")
def _semantic(t):
    return ops.semantic_search(_corpus(t), _queries(t), 10)


@query("semantic_search_in_blocks", ("retrieval",), f", {_search_sql(10)} SELECT query_id, rank, id, similarity FROM hi")
def _blocks(t):
    return ops.semantic_search(_corpus(t), _queries(t), 10, blocks=7)


@query("filtered_search", ("retrieval",), f", {_search_sql(8, where='c.label IN (1, 2, 3)')} SELECT query_id, rank, id, similarity FROM hi")
def _filtered(t):
    return ops.semantic_search(_corpus(t).filter(F.col("label").isin(1, 2, 3)), _queries(t), 8)


@query("neighbour_similarity", ("retrieval",), """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nxt AS DOUBLE[])), 6) AS similarity
FROM (SELECT a.vec_id, a.embedding, b.embedding AS nxt FROM retrieval a JOIN retrieval b ON b.vec_id = a.vec_id + 1) x""")
def _neighbours(t):
    nxt = t.retrieval.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return t.retrieval.join(nxt, "vec_id").select(
        "vec_id", F.round(ops.cosine_similarity(F.col("embedding"), F.col("nxt")), 6).alias("similarity")
    )


_FIRST = f"""{_search_sql(5)}, {_QS}, fh AS (SELECT qs.query_id, qs.kind, qs.style, coalesce(max(similarity), 0) AS top_similarity,
  CASE WHEN qs.kind = 'in_domain' THEN min(rank) FILTER (WHERE relevant) END AS first_rank
  FROM qs LEFT JOIN hi ON qs.query_id = hi.query_id GROUP BY qs.query_id, qs.kind, qs.style)"""


def _ranked(t):
    return ops.first_hit(_queries(t).select("query_id", "kind", "style"), _hits(t, 5))


@query("first_relevant_hit", ("retrieval",), f", {_FIRST} SELECT * FROM fh")
def _first(t):
    return _ranked(t)


@query("retrieval_scores", ("retrieval",), f""", {_FIRST} SELECT count(*) FILTER (WHERE kind = 'in_domain') AS in_domain, count(*) FILTER (WHERE kind <> 'in_domain') AS out_domain,
{rnd("avg(top_similarity) FILTER (WHERE kind = 'in_domain')", 4)} AS mean_similarity_in, {rnd("avg(top_similarity) FILTER (WHERE kind <> 'in_domain')", 4)} AS mean_similarity_out,
{rnd("max(top_similarity) FILTER (WHERE kind <> 'in_domain')", 4)} AS max_similarity_out,
count(*) FILTER (WHERE kind <> 'in_domain' AND top_similarity < 0.82) AS right_abstentions, count(*) FILTER (WHERE kind = 'in_domain' AND top_similarity < 0.82) AS wrong_abstentions,
{rnd("count(*) FILTER (WHERE kind <> 'in_domain' AND top_similarity < 0.82) / count(*) FILTER (WHERE kind <> 'in_domain')", 4)} AS right_abstention_rate,
{rnd("count(*) FILTER (WHERE kind = 'in_domain' AND top_similarity < 0.82) / count(*) FILTER (WHERE kind = 'in_domain')", 4)} AS wrong_abstention_rate,
{", ".join(f'''{rnd(f"count(*) FILTER (WHERE kind = 'in_domain' AND first_rank <= {k}) / count(*) FILTER (WHERE kind = 'in_domain')", 4)} AS recall_at_{k}''' for k in (1, 3, 5))} FROM fh""")
def _scores(t):
    return ops.retrieval_scores(_ranked(t))


_TH = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.74, 0.78, 0.8, 0.82, 0.84, 0.86, 0.9)
_SWEEP = f"""{_FIRST}, sw AS (SELECT CAST(u AS DOUBLE) AS threshold, count(*) FILTER (WHERE kind <> 'in_domain' AND top_similarity < u) AS right_abstentions,
count(*) FILTER (WHERE kind = 'in_domain' AND top_similarity < u) AS wrong_abstentions,
count(*) FILTER (WHERE (kind = 'in_domain') = (top_similarity >= u)) AS right_total,
{pct("count(*) FILTER (WHERE (kind = 'in_domain') = (top_similarity >= u))", 'count(*)', 1)} AS pct_right
FROM fh, (VALUES {", ".join(f"({u}::DOUBLE)" for u in _TH)}) v(u) GROUP BY u)"""


@query("threshold_sweep", ("retrieval",), f", {_SWEEP} SELECT * FROM sw")
def _sweep(t):
    return ops.threshold_sweep(_ranked(t), _TH)


@query("best_threshold", ("retrieval",), f", {_SWEEP} SELECT threshold FROM sw ORDER BY right_total DESC, threshold LIMIT 1")
def _best(t):
    return ops.best_threshold(ops.threshold_sweep(_ranked(t), _TH))


_CONTROL = f"""{_search_sql(1, 'ma', 'c.label < 5')}, {_search_sql(1, 'co', 'c.label >= 5')}, {_QS},
ex AS (SELECT qs.query_id, qs.kind, {rnd('coalesce(ma.similarity, 0)', 4)} AS in_main, {rnd('coalesce(co.similarity, 0)', 4)} AS in_control,
  {rnd('coalesce(co.similarity, 0) - coalesce(ma.similarity, 0)', 4)} AS delta FROM qs LEFT JOIN ma ON qs.query_id = ma.query_id LEFT JOIN co ON qs.query_id = co.query_id)"""


def _experiment(t):
    main = ops.semantic_search(_corpus(t).filter("label < 5"), _queries(t), 1)
    control = ops.semantic_search(_corpus(t).filter("label >= 5"), _queries(t), 1)
    return ops.control_experiment(_queries(t).select("query_id", "kind"), main, control)


@query("control_experiment", ("retrieval",), f", {_CONTROL} SELECT * FROM ex")
def _control(t):
    return _experiment(t)


@query("control_margins", ("retrieval",), f""", {_CONTROL} SELECT CAST(m AS DOUBLE) AS margin, count(*) FILTER (WHERE kind <> 'in_domain' AND delta > m) AS detected,
count(*) FILTER (WHERE kind = 'in_domain' AND delta > m) AS false_positives FROM ex, (VALUES (0.0::DOUBLE), (0.01), (0.02), (0.05)) v(m) GROUP BY m""")
def _margins(t):
    return ops.control_margins(_experiment(t))


@query("filter_effect", ("retrieval",), f""", {_search_sql(10, 'ht')}, {_search_sql(10, 'hf', 'c.label = q.label')}, {_QS},
a AS (SELECT label, count(*) AS retrieved_text, count(*) FILTER (WHERE relevant) AS match_text FROM ht JOIN qs ON ht.query_id = qs.query_id GROUP BY label),
b AS (SELECT label, count(*) AS retrieved_filter, count(*) FILTER (WHERE relevant) AS match_filter FROM hf JOIN qs ON hf.query_id = qs.query_id GROUP BY label)
SELECT a.label, retrieved_text, match_text, {pct('match_text', 'retrieved_text', 1)} AS pct_text, retrieved_filter, match_filter,
{pct('match_filter', 'retrieved_filter', 1)} AS pct_filter FROM a FULL JOIN b ON a.label = b.label""")
def _filter_effect(t):
    value = _corpus(t).select("id", F.col("label").alias("value"))
    text = ops.semantic_search(_corpus(t), _queries(t), 10).join(value, "id")
    kept = ops.semantic_search(_corpus(t), _queries(t), 10, scope="label").join(value, "id")
    return ops.filter_effect(_queries(t), text, kept, "label")


@query("abstention", ("retrieval",), f""", {_search_sql(5)}, {_QS},
b AS (SELECT query_id, max(similarity) AS s FROM hi GROUP BY 1),
d AS (SELECT qs.query_id, s AS top_similarity, CASE WHEN s IS NULL THEN 'sin resultados' WHEN s < 0.55 THEN 'similitud baja' ELSE 'responder' END AS decision
  FROM qs LEFT JOIN b ON qs.query_id = b.query_id)
SELECT *, decision <> 'responder' AS abstains FROM d""")
def _abstention(t):
    hits = ops.semantic_search(_corpus(t), _queries(t), 5)
    return ops.decide(_queries(t).select("query_id"), hits, 0.55)


_CTX = f"{_search_sql(5)}, hx AS (SELECT query_id, rank, similarity, value AS doc, id AS page, value % 4 = 0 AS amends, concat('texto ', id) AS text FROM hi)"


def _context_hits(t):
    return _hits(t, 5).select(
        "query_id", "rank", "similarity", F.col("value").alias("doc"), F.col("id").alias("page"),
        (F.col("value") % 4 == 0).alias("amends"), F.concat(F.lit("texto "), F.col("id").cast("string")).alias("text"),
    )


@query("context_blocks", ("retrieval",), f""", {_CTX} SELECT query_id, string_agg(concat('--- Fragmento ', rank, ' · [', doc, ', p. ', page, ']',
CASE WHEN amends THEN ' (NORMA MODIFICATORIA)' ELSE '' END, ' · similitud ', printf('%.3f', {rnd('similarity', 3)}), ' ---', chr(10), text), chr(10) || chr(10) ORDER BY rank) AS context FROM hx GROUP BY query_id""")
def _context(t):
    return ops.context_blocks(_context_hits(t))


@query("amendment_notes", ("retrieval",), f", {_CTX} SELECT query_id, coalesce(bool_or(amends) FILTER (WHERE rank <= 3), false) AS needs_note FROM hx GROUP BY query_id")
def _notes(t):
    return ops.amendment_notes(_context_hits(t))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
_BM25 = f""", dt AS (SELECT doc_id, {_TOK} AS tokens FROM documents),
ex AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM ex GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS ml FROM dt),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
wf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS w FROM df),
qt AS (SELECT item_id, unnest({_TOK}) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / ml))), 6) AS s FROM qt JOIN wf ON qt.term = wf.term JOIN tf ON tf.term = qt.term, st GROUP BY 1, 2),
bm AS (SELECT item_id AS query_id, doc_id AS id, s AS similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM sc)"""


#: Hits of a query.
K = 5


def _lexical(t, k=K):
    # The given files have one row group each; dealt by id, their texts are read into words by all tasks.
    corpus = t.documents.select(F.col("doc_id").alias("id"), "text").repartition("id")
    return ops.bm25_search(corpus, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), k)


@query("bm25_search", (), "WITH x AS (SELECT 1)" + _BM25 + " SELECT query_id, rank, id, similarity FROM bm WHERE rank <= 5")
def _bm25(t):
    return _lexical(t)


def _contains_item(t, hits):
    """A hit is relevant when the document holds the text of the item; few hits go to the texts, not the texts to them."""
    hits = lexical.small(hits, K * t.benchmark.count())
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return hits.join(texts, "id").join(items, "query_id").withColumn(
        "relevant", F.contains("text", "item")
    ).drop("text", "item")


def _items(t):
    return t.benchmark.select(
        F.col("item_id").alias("query_id"), F.lit("in_domain").alias("kind"),
        F.when(F.col("item_id") % 3 == 0, "colloquial").otherwise("formal").alias("style"),
    )


@query("bm25_first_relevant_hit", (), "WITH x AS (SELECT 1)" + _BM25 + """ SELECT b.item_id AS query_id, min(rank) FILTER (WHERE contains(d.text, b.text)) AS first_rank,
max(similarity) AS top_similarity FROM benchmark b LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) h ON h.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = h.id GROUP BY 1""")
def _bm25_first(t):
    return ops.first_hit(_items(t), _contains_item(t, _lexical(t))).select("query_id", "first_rank", "top_similarity")


_HASHED = f""", {hashed_sql("hd", "documents", "doc_id", "passage: ")}, {hashed_sql("hq", "benchmark", "item_id", "query: ")},
hs AS (SELECT q.k AS query_id, d.k AS id, round(sum(q.n * d.n) / any_value(qn.norm * dn.norm), 6) AS similarity
  FROM hq q JOIN hd d USING (slot) JOIN hq_n qn ON qn.k = q.k JOIN hd_n dn ON dn.k = d.k GROUP BY 1, 2),
hv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM hs)"""


def _compared_sql(within: int) -> str:
    def first(hits: str) -> str:
        return f"""(SELECT b.item_id, min(h.rank) FILTER (WHERE contains(d.text, b.text)) AS r FROM benchmark b
  LEFT JOIN (SELECT * FROM {hits} WHERE rank <= 5) h ON h.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = h.id GROUP BY 1)"""

    return f"""WITH x AS (SELECT 1){_BM25}{_HASHED}
SELECT CASE WHEN l.item_id % 3 = 0 THEN 'colloquial' ELSE 'formal' END AS style, count(*) AS queries,
{pct(f'count(*) FILTER (WHERE l.r <= {within})', 'count(*)', 1)} AS pct_lexical, {pct(f'count(*) FILTER (WHERE v.r <= {within})', 'count(*)', 1)} AS pct_semantic
FROM {first('bm')} l JOIN {first('hv')} v USING (item_id) GROUP BY 1"""


def _compared(t, within):
    """BM25 and hashed vectors over all documents and items."""
    corpus = docs.encode_passages(t.documents.select(F.col("doc_id").alias("id"), "text"), unit=False).select("id", "embedding")
    asked = docs.encode_queries(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), unit=False).select("query_id", "embedding")
    blocks = ops.blocks_for(t.documents, F.count("*"), docs.SLOTS)
    return ops.compare_rankings(_items(t), _contains_item(t, _lexical(t)), _contains_item(t, ops.semantic_search(corpus, asked, K, blocks=blocks)), within)


@query("lexical_and_semantic_by_style", (), _compared_sql(3))
def _styles(t):
    return _compared(t, 3)


@query("ranking_comparison", (), _compared_sql(1))
def _rankings(t):
    return _compared(t, 1)


_THEMES = {"T1": "(license|licence)", "T2": "the ", "T3": r"\d{3}", "T4": "(apache|mit license)", "T5": "zzzz", "T6": "tion"}


@query("gold_by_pattern", (), r"""WITH m AS (SELECT doc_id, theme FROM documents, (VALUES ('T1', '(license|licence)'), ('T2', 'the '), ('T3', '\d{3}'),
('T4', '(apache|mit license)'), ('T5', 'zzzz'), ('T6', 'tion')) v(theme, p) WHERE regexp_matches(lower(concat(source, ' ', text)), p)),
r AS (SELECT theme, doc_id, count(*) OVER (PARTITION BY theme) AS relevant FROM m)
SELECT theme, doc_id, relevant FROM r WHERE relevant >= 3""")
def _gold(t):
    return ops.gold_by_pattern(t.documents, _THEMES, "doc_id", F.concat_ws(" ", "source", "text"))


@query("expected_page_hits", ("book",), f""", {_FIXED} SELECT id, doc = concat('src', page % 20) AND (abs(page - (page % 7 + page - 3)) <= 1 OR abs(page - (page + 2)) <= 1) AS hit FROM fx""")
def _pages(t):
    page = F.col("page")
    cell = F.concat((page % 7 + page - 3).cast("string"), F.lit("; "), (page + 2).cast("string"), F.lit(";x,"))
    return docs.fixed_windows(t.book).select("id", ops.on_expected_page(
        F.col("doc"), page, F.concat(F.lit("src"), (page % 20).cast("string")), ops.page_set(cell)
    ).alias("hit"))


@query("incremental_load", ("book",), f""", {_FIXED} SELECT id, doc FROM fx WHERE NOT (n_in_page % 2 = 0)""")
def _incremental(t):
    chunks = docs.fixed_windows(t.book)
    stored = chunks.filter("n_in_page % 2 = 0")
    return index.missing_rows(chunks, stored).select("id", "doc")


@query("incremental_load_by_batch", ("book",), f""", {_FIXED} SELECT id, doc, page FROM fx WHERE page % 3 <> 2""")
def _by_batch(t):
    """Two batches, the first of them three times: under its mark, and without one with rows added in the meantime."""
    path = scratch(t.spark, "batches")
    chunks = pin(docs.fixed_windows(t.book).select("id", "doc", "page"))
    for batch, residue in (("a", 0), ("b", 1), ("a", 2)):
        index.load_index(chunks.filter(F.col("page") % 3 == residue), path, batch=batch)
    index.load_index(chunks.filter(F.col("page") % 3 == 0), path)
    index.compact(t.spark, path)
    return index.read_index(t.spark, path)


@query("parsed_answers", (), """SELECT conv_id, turn, turn % 5 <> 4 AND turn % 3 = 2 AS abstains,
CASE WHEN turn % 5 = 4 THEN concat('no json ', text) WHEN turn % 3 <> 2 AND turn % 2 = 0 THEN concat(trim(text), chr(10), chr(10), 'Fuentes citadas: [', role, ', p. ', turn, ']') ELSE trim(text) END AS answer,
CASE WHEN turn % 5 <> 4 AND turn % 3 = 2 THEN 'fuera del corpus' ELSE '' END AS reason FROM conversations""")
def _answers(t):
    turn = F.col("turn")
    body = F.to_json(F.struct(
        (turn % 3 != 2).alias("puede_responder"), F.col("text").alias("respuesta"),
        F.when(turn % 2 == 0, F.array(F.concat(F.col("role"), F.lit(", p. "), turn.cast("string")))).alias("citas"),
        F.when(turn % 3 == 2, F.lit(" fuera del corpus ")).alias("motivo"),
    ))
    raw = F.when(turn % 5 == 4, F.concat(F.lit("no json "), F.col("text"))).otherwise(body)
    return ops.parse_answers(t.conversations.withColumn("raw", raw)).select("conv_id", "turn", "answer", "abstains", "reason")


@query("fragment_size_evaluation")
def _sizes(t):
    """Re-chunk, re-encode and score every size in one job; a fragment's size is part of its search scope.

    A task splits its texts, counts and scores their fragments and keeps the best; no vector leaves it. Only more items than may go to
    every task have the fragments dealt to blocks instead."""
    sizes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in CHUNK_SWEEP])
    pages = t.documents.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    chunks = docs.chunk_pages(pages.select("*", F.inline(sizes)))
    # The document's id is a number and the second part of a fragment's id.
    marked = chunks.withColumn("id", F.concat_ws("|", F.col("size").cast("string"), F.col("doc").cast("string"), "id"))
    items = t.benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    if ops.few(items, docs.SLOTS):
        asked = docs.encode_queries(items, unit=False).withColumnRenamed("item_id", "query_id")
        texts = marked.select("id", "size", "chars", docs.prepared(F.col("text"), docs.PASSAGE).alias("text"))
        hits, lengths = ops.search_texts(texts, asked, 5, docs.word_counts, scope="size", total="chars")
        hits = hits.withColumn("query_id", F.concat_ws("|", F.col("size").cast("string"), "query_id"))
    else:
        hits, lengths = _sizes_in_blocks(t, marked, items)
    each = items.select("text", F.explode(F.array(*[F.lit(s) for s, _ in CHUNK_SWEEP])).alias("size"), "item_id")
    each = each.select("size", F.col("text").alias("item"), F.concat_ws("|", F.col("size").cast("string"), "item_id").alias("query_id"))
    whole = t.documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("whole"))
    doc = F.split_part("id", F.lit("|"), F.lit(2)).cast(whole.schema["doc"].dataType)
    # Few hits go to the texts, not the texts to them.
    found = lexical.small(hits.select("query_id", "rank", "similarity", doc.alias("doc")), 5 * len(CHUNK_SWEEP) * items.count())
    judged = found.join(whole, "doc").join(each.select("query_id", "item"), "query_id").withColumn("relevant", F.contains("whole", "item"))
    ranked = ops.first_hit(each.select("query_id", "size", F.lit("in_domain").alias("kind")), judged)
    n = F.count("*")
    recall = [F.round(F.count_if(ops.true(F.col("first_rank") <= k)) / n, 4).alias(f"recall_at_{k}") for k in (1, 3, 5)]
    means = lengths.select("size", F.col("n").alias("fragments"), F.round(F.col("total") / F.col("n"), 1).alias("chars_mean"))
    return ranked.groupBy("size").agg(*recall).join(means, "size")


def _sizes_in_blocks(t, marked, items):
    """The number of blocks follows from the characters: two fragments in a row hold about a size, short ones beside a long piece apart."""
    each = items.select("text", F.explode(F.array(*[F.lit(s) for s, _ in CHUNK_SWEEP])).alias("size"), "item_id")
    asked = docs.encode_queries(each.withColumn("query_id", F.concat_ws("|", F.col("size").cast("string"), "item_id")), unit=False)
    blocks = ops.blocks_for(t.documents, F.sum(sum((F.ceil(2 * F.length("text") / s) for s, _ in CHUNK_SWEEP), F.lit(0))), docs.SLOTS)
    vectors = docs.encode_passages(marked, unit=False).select("id", "size", "embedding")
    hits = ops.semantic_search(vectors, asked.select("query_id", "size", "embedding"), 5, scope="size", blocks=blocks)
    return hits, marked.groupBy("size").agg(F.count("*").alias("n"), F.sum("chars").alias("total"))
