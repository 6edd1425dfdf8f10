"""One registered query per operator, over its whole table, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almenara.llm import decontamination, jaccard, language, lines, mixing, nearest, packing, pages, quality, ranked, sharding, toxicity, whitening
from almenara.llm.columns import small
from almenara.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(0))


def marks(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """The labels to learn from: those outside the held-out third."""
    return table(spark, folder, "labels").filter(remainder(3) != 1).select("doc_id", F.col(label).alias("label"))


@query
def op1_html_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    weights = quality.fit(documents, marks(spark, folder, "quality"))
    return quality.score(documents, weights).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_mixing_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    sizes = pin(mixing.sized(table(spark, folder, "documents")))
    rows = mixing.decided(sizes, mixing.plan(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op4_mixing_thresholds"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS weight, CAST(source_size * 3 AS DOUBLE) / [5, 2, 1][k % 3 + 1] AS ratio FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER f, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(source_size * 3 AS DOUBLE), coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 0.0) * weight) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN 2 * upto - size < 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query
def op5_sharding_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.placed(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontamination.judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Fixed values of the contract: characters that are not part of a word once A-Z are lower-cased.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS run
       FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS run
       FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, run)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""


@query
def op7_multi_index_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op8_toxicity_segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, marks(spark, folder, "toxic"))
    return toxicity.score(documents, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, i, parts[i] AS line,
             translate(trim(parts[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT rid, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@query
def op10_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(documents.filter(remainder(4) != 2))
    return language.predict(documents.drop("lang"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op11_block_matrix_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_fp_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Fixed values of the contract: characters that are not part of a term, A-Z being lower-cased first.
_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op12_fp_tree_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS words FROM documents),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) GROUP BY rid, term),
s AS (SELECT count(*) AS n_all, CAST(sum(len(words)) AS BIGINT) AS l_all FROM d WHERE len(words) > 0),
m AS (SELECT rid, doc_id, 50 + (50 * CAST(len(words) AS BIGINT) * n_all) // l_all AS m FROM d, s WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n_all),
r AS (SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


@query
def op13_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
