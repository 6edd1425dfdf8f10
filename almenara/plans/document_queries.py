"""Queries on page cleaning, chunking and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.functions.numeric import rounded
from almenara.operators import documents as ops
from almenara.operators import quality
from almenara.plans.oracle_text import pct, rnd
from almenara.plans.registry import query
from almenara.settings import CHUNK_SEPARATORS, CHUNK_SWEEP, HEADER_PATTERNS, TEXT

_RE = [p.replace("'", "''") for p in HEADER_PATTERNS]


def _removed(n: int) -> str:
    """Text after the first ``n`` patterns."""
    t = "text"
    for p in _RE[:n]:
        t = f"regexp_replace({t}, '(?im){p}', ' ', 'g')"
    return t


_CLEAN = f"""c1 AS (SELECT doc, page, text, {_removed(len(_RE))} AS t FROM book),
c2 AS (SELECT doc, page, text, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM c1),
c3 AS (SELECT doc, page, text, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g') AS t FROM c2),
cl AS (SELECT doc, page, text, trim(t, ' ' || chr(10) || chr(9) || chr(13)) AS clean FROM c3),
cu AS (SELECT *, length(clean) >= 40 AS useful FROM cl)"""


def _cleaned(t):
    return ops.clean_pages(t.book)


@query("cleaned_pages", ("book",), f", {_CLEAN} SELECT doc, page, useful, CAST(length(clean) AS INTEGER) AS chars, md5(clean) AS digest FROM cu")
def _clean(t):
    return _cleaned(t).select("doc", "page", "useful", F.length("clean").alias("chars"), F.md5("clean").alias("digest"))


@query("cleaning_pattern_hits", ("book",), ", x AS (SELECT 1) " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{p}' AS pattern, CAST(coalesce(sum(len(regexp_extract_all({_removed(i)}, '(?im){p}'))), 0) AS BIGINT) AS hits FROM book"
    for i, p in enumerate(_RE)))
def _hits(t):
    return ops.pattern_hits(t.book)


@query("extraction_quality", ("book",), f""", {_CLEAN} SELECT doc, count(*) AS pages, count(*) FILTER (WHERE useful) AS useful_pages,
count(*) FILTER (WHERE NOT useful) AS dropped_pages, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(clean)) AS BIGINT) AS chars_after,
{pct('sum(length(text)) - sum(length(clean))', 'sum(length(text))')} AS pct_removed, {rnd('sum(length(clean)) / count(*)', 1)} AS chars_per_page FROM cu GROUP BY doc""")
def _quality(t):
    return ops.extraction_quality(_cleaned(t))


@query("most_reduced_page", ("book",), f""", {_CLEAN}, m AS (SELECT *, round(1 - length(clean) / greatest(length(text), 1), 9) AS cut FROM cu WHERE length(text) > 500)
SELECT doc, page, {rnd('100 * cut', 1)} AS pct_removed, md5(text) AS before, md5(clean) AS after
FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cut DESC, page) AS r FROM m) z WHERE r = 1""")
def _reduced(t):
    return ops.most_reduced_page(_cleaned(t)).select(
        "doc", "page", "pct_removed", F.md5("text").alias("before"), F.md5("clean").alias("after")
    )


_FIXED = """fw AS (SELECT doc, page, CAST(n_in_page AS INTEGER) AS n_in_page, trim(substr(text, n_in_page * 750 + 1, 900)) AS text FROM
  (SELECT *, unnest(range(0, CAST(greatest(ceil((length(text) - 150) / 750.0), 1) AS BIGINT))) AS n_in_page FROM book) x),
fx AS (SELECT *, CAST(length(text) AS INTEGER) AS chars, printf('%s::p%04d::c%03d::%s', doc, page, n_in_page, substr(sha1(text), 1, 10)) AS id FROM fw WHERE length(text) >= 40)"""


@query("fixed_window_fragments", ("book",), f", {_FIXED} SELECT doc, page, n_in_page, chars, id FROM fx")
def _fixed(t):
    return ops.fixed_windows(t.book).select("doc", "page", "n_in_page", "chars", "id")


@query("fragment_summary", ("book",), f""", {_FIXED} SELECT doc, count(*) AS fragments, min(chars) AS chars_min, max(chars) AS chars_max,
{rnd('avg(chars)', 1)} AS chars_mean, count(DISTINCT page) AS pages, {rnd('quantile_cont(chars, 0.25)', 0)} AS chars_p25,
{rnd('quantile_cont(chars, 0.5)', 0)} AS chars_median, {rnd('quantile_cont(chars, 0.75)', 0)} AS chars_p75,
max(chars) / 3.7 > 0.9 * 512 AS near_token_limit FROM fx GROUP BY doc""")
def _summary(t):
    return ops.fragment_summary(ops.fixed_windows(t.book))


def _useful(t):
    """A page too short to be useful has no fragment of the minimum length either."""
    return _cleaned(t).select("doc", "page", F.col("clean").alias("text"))


def _quoted(text: str) -> str:
    return " || chr(10) || ".join(f"'{part}'" for part in text.split("\n"))


def split_sql(pages: str, result: str) -> str:
    """A query of the fragments (doc, page, size, overlap, n_in_page, text) of ``pages`` (doc, page, size, overlap, t).

    Every separator is one level: texts that hold it are cut, long pieces go on to the next level and runs of short ones
    become rows of piece lengths. One recursive query then walks all runs from fragment to fragment by their ends."""
    key = "doc, page, size, overlap"
    steps = [f"o0 AS (SELECT {key}, CAST([] AS BIGINT[]) AS path, t FROM {pages} WHERE t <> '')"]
    for i, separator in enumerate(CHUNK_SEPARATORS):
        s = _quoted(separator)
        steps.append(f"""x{i} AS (SELECT {key}, path, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT *, list_filter(list_transform(string_split(t, {s}),
  lambda q, k: CASE WHEN k > 1 THEN {s} || q ELSE q END), lambda q: q <> '') AS ps FROM o{i} WHERE contains(t, {s})) z),
g{i} AS (SELECT *, length(p) >= size AS long, sum(CASE WHEN length(p) >= size THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, path ORDER BY j) AS run FROM x{i}),
r{i} AS (SELECT {key}, path, min(j) AS a, list(length(p) ORDER BY j) AS ls, string_agg(p, '' ORDER BY j) AS whole FROM g{i} WHERE NOT long GROUP BY {key}, path, run),
o{i + 1} AS (SELECT {key}, path, t FROM o{i} WHERE NOT contains(t, {s}) UNION ALL SELECT {key}, list_append(path, j), p FROM g{i} WHERE long)""")
    last = len(CHUNK_SEPARATORS)
    end = "coalesce(list_min(list_filter(range({s} + 1, m + 1), lambda i: cs[i + 1] - cs[{s}] > size)), m + 1)"
    runs = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(last))
    trimmed = "trim({t}, ' ' || chr(10) || chr(9) || chr(13))"
    return f"""SELECT * FROM (WITH RECURSIVE {", ".join(steps)},
rn AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, len(ls) AS m, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(ls[1:i]), 0)) AS cs FROM ({runs}) u),
pk AS (SELECT rid, CAST(1 AS BIGINT) AS s, CAST({end.format(s="1")} AS BIGINT) AS e FROM rn
  UNION ALL SELECT rid, n AS s, CAST({end.format(s="n")} AS BIGINT) AS e FROM (SELECT rn.*, CAST(list_min(list_filter(range(pk.s, pk.e + 1),
    lambda d: NOT (cs[pk.e] - cs[d] > overlap OR (cs[pk.e] - cs[d] > 0 AND cs[pk.e] - cs[d] + ls[pk.e] > size)))) AS BIGINT) AS n FROM pk JOIN rn USING (rid) WHERE pk.e <= m) y),
fr AS (SELECT {key}, list_append(path, a + s - 1) AS path, {trimmed.format(t="substr(whole, CAST(cs[s] + 1 AS BIGINT), CAST(cs[e] - cs[s] AS BIGINT))")} AS text FROM pk JOIN rn USING (rid)
  UNION ALL SELECT {key}, path, {trimmed.format(t="t")} FROM o{last})
SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY path) - 1 AS INTEGER) AS n_in_page, text FROM fr WHERE text <> '') {result}"""


_SPLIT = f""", {_CLEAN}, pg AS (SELECT doc, page, {TEXT.chunk_size} AS size, {TEXT.chunk_overlap} AS overlap, clean AS t FROM cu),
fs AS ({split_sql("pg", "w")})"""


@query("recursive_fragments", ("book",), f"""{_SPLIT} SELECT doc, page, n_in_page, CAST(length(text) AS INTEGER) AS chars,
printf('%s::p%04d::c%03d::%s', doc, page, n_in_page, substr(sha1(text), 1, 10)) AS id FROM fs WHERE length(text) >= {TEXT.min_chars}""")
def _recursive(t):
    return ops.chunk_pages(_useful(t)).select("doc", "page", "n_in_page", "chars", "id")


@query("recursive_fragment_contracts", ("book",), "SELECT * FROM (VALUES ('id unico', 0::BIGINT, true), ('fragmento dentro de su pagina', 0, true), ('minimo de caracteres', 0, true)) v(contract, violations, ok)")
def _contracts(t):
    pages = _useful(t)
    chunks = ops.chunk_pages(pages)
    inside = chunks.join(pages.withColumnRenamed("text", "whole"), ["doc", "page"])
    return quality.all_contracts(
        quality.expect_unique("id unico", chunks, "id"),
        quality.expect_rows(inside, {
            "fragmento dentro de su pagina": F.contains(F.col("whole"), F.col("text")),
            "minimo de caracteres": F.col("chars") >= 40,
        }),
    )


_SIZES = ", ".join(f"({s}, {o})" for s, o in CHUNK_SWEEP)


@query("fragment_size_sweep", ("book",), f""", {_CLEAN}, pg AS (SELECT doc, page, size, overlap, clean AS t FROM cu, (VALUES {_SIZES}) v(size, overlap)),
fs AS ({split_sql("pg", "w")})
SELECT size, overlap, count(*) AS fragments, round(avg(length(text)), 1) AS chars_mean, CAST(max(length(text)) AS INTEGER) AS chars_max
FROM fs WHERE length(text) >= {TEXT.min_chars} GROUP BY size, overlap""")
def _sweep(t):
    sizes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in CHUNK_SWEEP])
    pages = _useful(t).select("*", F.inline(sizes))
    return ops.chunk_pages(pages).groupBy("size", "overlap").agg(
        F.count("*").alias("fragments"), F.round(F.avg("chars"), 1).alias("chars_mean"), F.max("chars").alias("chars_max")
    )


#: Signed word counts in 384 slots by MD5, as (key, slot, n) rows without zeros.
def hashed_sql(name: str, table: str, key: str, prefix: str) -> str:
    return rf"""{name}_w AS (SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower(concat('{prefix}', coalesce(text, ''))), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM {table}),
{name} AS (SELECT k, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS INTEGER) AS slot, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS n FROM {name}_w GROUP BY 1, 2 HAVING n <> 0),
{name}_n AS (SELECT k, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY 1)"""


@query("passage_vectors", (), f"""WITH {hashed_sql("hp", "documents", "doc_id", "passage: ")}
SELECT k AS doc_id, 384 AS dims, round(sqrt(sum((n / norm) * (n / norm))), 4) AS norm, CAST(count(*) AS INTEGER) AS used, {rnd('sum((slot + 1) * n / norm)', 4)} AS moment
FROM hp JOIN hp_n USING (k) GROUP BY k""")
def _vectors(t):
    v = ops.encode_passages(t.documents.select("doc_id", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    moment = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select(
        "doc_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("used"), rounded(moment, 4).alias("moment"),
    )
