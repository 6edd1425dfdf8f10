"""Queries on tenders, their territory and risk indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.functions.text import latin_key
from almenara.operators import procurement as ops
from almenara.operators import quality, territory
from almenara.plans.oracle_text import pct, rnd
from almenara.plans.registry import query
from almenara.settings import METHOD_CONCEPTS, NO_EQUIVALENT_CONCEPT, NO_EQUIVALENT_NOTICE, RISK

# Names of the 25 rows of the nation table, which stand for the departments.
_CANON = tuple(f"NATION_{i}" for i in range(25))
_ALIASES = {"NATIONX_7": "NATION_7"}
_KEY = r"trim(regexp_replace(upper(coalesce({c}, '')), '\s+', ' ', 'g'))"


def _canonical(c: str) -> str:
    k = _KEY.format(c=c)
    return f"CASE WHEN {k} IN (SELECT n_name FROM nation) THEN {k} WHEN {k} = 'NATIONX_7' THEN 'NATION_7' END"


def _fuzzy_scores(keys: str) -> str:
    """CTEs that end in ``scored (k, n_name, n_nationkey, s)``: every text of ``keys (k)`` against every nation.

    Names are single words here, so their only set of shared words is the name itself. The subsequence is that of the
    bit-parallel recurrence, on pairs of texts that are listed once."""
    return rf"""nk AS (SELECT k, n_name, n_nationkey, array_to_string(list_sort(list_filter(string_split(k, ' '), lambda w: w <> '')), ' ') AS sk,
  array_to_string(list_sort(list_distinct(list_filter(string_split(k, ' '), lambda w: w <> ''))), ' ') AS uk, list_contains(string_split(k, ' '), n_name) AS holds,
  greatest(length(k), length(n_name)) / least(length(k), length(n_name)) AS ratio FROM {keys}, nation WHERE k <> ''),
rd AS (SELECT k, n_name, 'whole' AS r, k AS x, n_name AS y FROM nk UNION ALL SELECT k, n_name, 'sorted', sk, n_name FROM nk UNION ALL SELECT k, n_name, 'unique', uk, n_name FROM nk),
ends AS (SELECT k, n_name, r || '_part' AS r, sh, lo, unnest(range(1, length(sh) + length(lo))) AS e
  FROM (SELECT *, CASE WHEN length(x) < length(y) THEN x ELSE y END AS sh, CASE WHEN length(x) < length(y) THEN y ELSE x END AS lo FROM rd UNION ALL SELECT *, x, y FROM rd WHERE length(x) = length(y))),
rw AS (SELECT * FROM rd UNION ALL SELECT k, n_name, r, substr(lo, greatest(e - length(sh), 0) + 1, least(e, length(lo)) - greatest(e - length(sh), 0)), sh FROM ends),
bits AS (SELECT x, y, (1::BIGINT << length(y)) - 1 AS f, list_transform(string_split(x, ''), lambda c: CAST(list_sum(list_transform(range(0, length(y)),
  lambda i: CASE WHEN substr(y, CAST(i AS INTEGER) + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)) AS ms FROM (SELECT DISTINCT x, y FROM rw)),
lc AS (SELECT x, y, 200.0::DOUBLE * (length(y) - bit_count(list_reduce(ms, lambda v, m: ((v + (v & m)) | (v - (v & m))) & f, f))) / (length(x) + length(y)) AS share FROM bits),
best AS (SELECT k, n_name, r, max(share) AS b FROM rw JOIN lc USING (x, y) GROUP BY k, n_name, r),
rs0 AS (SELECT nk.*, (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'whole') AS w, (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'sorted') AS o,
  (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'unique') AS u, (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'whole_part') AS wp,
  (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'sorted_part') AS op, (SELECT b FROM best t WHERE t.k = nk.k AND t.n_name = nk.n_name AND r = 'unique_part') AS up,
  CASE WHEN ratio <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS weight FROM nk),
scored AS (SELECT k, n_name, n_nationkey, greatest(w, CASE WHEN ratio < 1.5 THEN 0.95::DOUBLE * greatest(o, CASE WHEN holds THEN 100.0 ELSE u END)
  ELSE greatest(weight * wp, 0.95::DOUBLE * weight * CASE WHEN holds THEN 100.0 ELSE greatest(op, up) END) END) AS s FROM rs0)"""


_BUILD = """lt AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY ocid ORDER BY month_file DESC) AS r FROM tenders) x WHERE r = 1),
bu AS (SELECT * EXCLUDE (r, roles, ord) FROM (SELECT *, row_number() OVER (PARTITION BY ocid ORDER BY ord) AS r FROM parties WHERE lower(coalesce(roles, '')) LIKE '%buyer%') x WHERE r = 1),
aw AS (SELECT ocid, count(*) AS awards, coalesce(sum(amount), 0) AS awarded_amount, max(award_date) AS award_date FROM awards GROUP BY ocid),
pr AS (SELECT lt.*, bu.* EXCLUDE (ocid), awarded_amount, award_date, coalesce(awards, 0) > 0 AS awarded
  FROM lt LEFT JOIN bu ON lt.ocid = bu.ocid LEFT JOIN aw ON lt.ocid = aw.ocid)"""

_RESOLVE = f"""{_BUILD},
t1 AS (SELECT *, {_canonical('department_raw')} AS d1, {_canonical('region_raw')} AS d2, {_KEY.format(c='locality_raw')} AS k FROM pr),
vt AS (SELECT entity_id, coalesce(d1, d2) AS d, count(*) AS n FROM t1 WHERE coalesce(d1, d2) IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2),
us AS (SELECT entity_id, d AS d3 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, d) AS r FROM vt) x WHERE r = 1),
{_fuzzy_scores('(SELECT DISTINCT k FROM t1) y')},
fz AS (SELECT k, max(s) AS score, arg_max(n_name, {{'s': s, 'o': -n_nationkey}}) AS name FROM scored GROUP BY k),
t2 AS (SELECT t1.*, d3, CASE WHEN coalesce(d1, d2, d3) IS NULL AND score >= 88 THEN name END AS d4, score FROM t1
  LEFT JOIN us ON t1.entity_id = us.entity_id LEFT JOIN fz ON t1.k = fz.k),
rs AS (SELECT * EXCLUDE (d1, d2, d3, d4, k, score), coalesce(d1, d2, d3, d4, 'NO_LOCALIZADO') AS department,
  CASE WHEN d1 IS NOT NULL THEN 'campo_departamento' WHEN d2 IS NOT NULL THEN 'campo_region' WHEN d3 IS NOT NULL THEN 'imputado_por_entidad'
    WHEN d4 IS NOT NULL THEN 'fuzzy_localidad' ELSE 'no_localizado' END AS department_origin,
  CASE WHEN coalesce(d1, d2) IS NOT NULL THEN 100.0 WHEN d3 IS NOT NULL THEN 90.0 WHEN d4 IS NOT NULL THEN score ELSE 0.0 END AS department_score FROM t2)"""
_READS = ("tenders", "parties", "awards")


def _processes(t):
    return ops.build_processes(t.tenders, t.parties, t.awards)


def _resolved(t):
    return territory.resolve_departments(_processes(t), _CANON, _ALIASES, key=latin_key)


@query("processes", _READS, f", {_BUILD} SELECT * REPLACE (round(awarded_amount, 2) AS awarded_amount) FROM pr")
def _processes_query(t):
    return _processes(t).withColumn("awarded_amount", F.round("awarded_amount", 2))


@query("process_row_counts", _READS, f""", {_BUILD} SELECT 'concatenado de los meses' AS step, count(*) AS rows, count(DISTINCT ocid) AS keys FROM tenders
UNION ALL SELECT 'una fila por ocid', count(*), count(DISTINCT ocid) FROM lt
UNION ALL SELECT 'con comprador y adjudicacion', count(*), count(DISTINCT ocid) FROM pr""")
def _row_counts(t):
    return ops.row_counts({
        "concatenado de los meses": t.tenders, "una fila por ocid": ops.latest_snapshot(t.tenders),
        "con comprador y adjudicacion": _processes(t),
    })


@query("monthly_row_counts", ("tenders",), "SELECT month_file, count(*) AS rows, count(DISTINCT ocid) AS keys FROM tenders GROUP BY month_file")
def _monthly(t):
    return ops.monthly_counts(t.tenders)


@query("resolved_departments", _READS, f", {_RESOLVE} SELECT ocid, department, department_origin, round(department_score, 6) AS department_score FROM rs")
def _resolved_query(t):
    return _resolved(t).select("ocid", "department", "department_origin", F.round("department_score", 6).alias("department_score"))


_STEPS = territory.STEPS


@query("department_recovery", _READS, f", {_RESOLVE} " + " UNION ALL ".join(
    f"SELECT '{s}' AS step, count(*) FILTER (WHERE department_origin = '{o}') AS rows, {pct(f'''count(*) FILTER (WHERE department_origin = '{o}')''', 'count(*)')} AS pct FROM rs"
    for s, o in _STEPS) + f""" UNION ALL SELECT 'TOTAL_LOCALIZADOS', count(*) FILTER (WHERE department_origin <> 'no_localizado'),
{pct("count(*) FILTER (WHERE department_origin <> 'no_localizado')", 'count(*)')} FROM rs""")
def _recovery(t):
    return territory.recovery_report(_resolved(t))


@query("canonical_names", ("parties",), f"SELECT DISTINCT department_raw, {_canonical('department_raw')} AS department FROM parties")
def _canonical_query(t):
    k = latin_key("department_raw")
    return t.parties.select("department_raw", territory.canonical(k, _CANON, _ALIASES).alias("department")).distinct()


@query("fuzzy_names", ("parties",), f""", k AS (SELECT DISTINCT {_KEY.format(c='locality_raw')} AS k FROM parties),
{_fuzzy_scores('(SELECT k FROM k) y')}
SELECT k AS key, round(max(s), 6) AS score, arg_max(n_name, {{'s': s, 'o': -n_nationkey}}) AS name FROM scored GROUP BY k""")
def _fuzzy(t):
    words = t.parties.select(latin_key("locality_raw").alias("key")).distinct()
    f = territory.fuzzy(F.col("key"), _CANON)
    return words.withColumn("f", f).select("key", F.round("f.score", 6).alias("score"), "f.name")


@query("usual_department", ("parties",), """, v AS (SELECT entity_id, department_raw, count(*) AS n FROM parties WHERE department_raw IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, department_raw FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, department_raw) AS r FROM v) x WHERE r = 1""")
def _usual(t):
    return territory.usual_value(t.parties, "entity_id", "department_raw")


_FLAGS = f"""{_RESOLVE}, fl AS (SELECT *, count(*) OVER (PARTITION BY ocid) > 1 AS flag_duplicate,
  NOT coalesce(amount > 0, false) AS flag_no_amount, length(trim(coalesce(description, ''))) < 10 AS flag_no_description,
  {_KEY.format(c='locality_raw')} <> '' AND {_KEY.format(c='locality_raw')} NOT IN (SELECT n_name FROM nation) AS flag_locality_not_department,
  trim(coalesce(department_raw, '')) <> '' AND trim(coalesce(department_raw, '')) <> {_KEY.format(c='department_raw')} AS flag_spelling,
  department = 'NO_LOCALIZADO' AS flag_no_department, published IS NULL AS flag_no_date FROM rs)"""
_FLAG_NAMES = [f for _, f, _ in ops.TENDER_RULES]


def _flagged(t):
    return ops.flag_tenders(_resolved(t), _CANON, latin_key)


@query("tender_flags", _READS, f", {_FLAGS} SELECT ocid, {', '.join(_FLAG_NAMES)}, NOT flag_no_description AS fit_for_index, NOT flag_no_department AS fit_for_map FROM fl")
def _flags(t):
    return _flagged(t).select("ocid", *_FLAG_NAMES, "fit_for_index", "fit_for_map")


@query("tender_copies", ("tenders",), "SELECT ocid, month_file, count(*) OVER (PARTITION BY ocid) > 1 AS is_copy FROM tenders")
def _copies(t):
    return quality.flag_copies(t.tenders, "ocid", "is_copy").select("ocid", "month_file", "is_copy")


@query("tender_rule_report", _READS, f", {_FLAGS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS rule, '{d}' AS description, count(*) AS evaluated, count(*) FILTER (WHERE {f}) AS flagged, 0::BIGINT AS recovered, 0::BIGINT AS discarded, '' AS reason,
{rnd(f'100.0 * count(*) FILTER (WHERE {f}) / count(*)', 3)} AS pct_flagged, 0.0::DOUBLE AS pct_recovered,
CASE WHEN count(*) FILTER (WHERE {f}) = 0 THEN 'SIN_HALLAZGOS' ELSE 'RETENIDO' END AS action FROM fl""" for c, f, d in ops.TENDER_RULES))
def _tender_report(t):
    return quality.rule_report(_flagged(t), ops.tender_rules())


_FILTERS = ops.Filters(
    departments=("NATION_1", "NATION_2", "NATION_3", "NATION_4"), categories=("1-URGENT", "2-HIGH", "3-MEDIUM"),
    amount_min=0.0, amount_max=300000.0, date_from="1993-01-01", date_to="1999-12-31", awarded_only=True,
)


@query("structured_filter", _READS, f""", {_RESOLVE} SELECT ocid, department FROM rs WHERE department IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')
AND category IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND coalesce(amount, 0) >= 0 AND coalesce(amount, 0) <= 300000
AND (published IS NULL OR strftime(published, '%Y-%m-%d') BETWEEN '1993-01-01' AND '1999-12-31') AND awarded""")
def _filter(t):
    return _resolved(t).filter(_FILTERS.predicate()).select("ocid", "department")


@query("dashboard_filter", _READS, f""", {_RESOLVE} SELECT ocid, amount FROM rs WHERE department IN ('NATION_1', 'NATION_5') AND
(amount BETWEEN 1000 AND 250000 OR amount IS NULL) AND (CAST(published AS DATE) BETWEEN DATE '1994-01-01' AND DATE '2000-12-31' OR published IS NULL)""")
def _dashboard(t):
    return ops.dashboard_filter(
        _resolved(t), departments=("NATION_1", "NATION_5"), amount=(1000.0, 250000.0), dates=("1994-01-01", "2000-12-31")
    ).select("ocid", "amount")


_BASE = f"{_RESOLVE}, ba AS (SELECT *, bidders = 1 AS one FROM rs WHERE awarded AND bidders >= 1)"
_ONE = f"count(*) AS awarded_processes, count(*) FILTER (WHERE one) AS single_bidder, {pct('count(*) FILTER (WHERE one)', 'count(*)')} AS pct_single_bidder"
_AMOUNT = f"{rnd('coalesce(sum(amount), 0)', 0)} AS amount_total"


@query("single_bidder_overall", _READS, f", {_BASE} SELECT {_ONE}, quantile_cont(bidders, 0.5) AS median_bidders FROM ba")
def _overall(t):
    return ops.single_bidder_overall(_resolved(t))


@query("single_bidder_by_department", _READS, f", {_BASE} SELECT department, {_ONE}, {_AMOUNT}, quantile_cont(bidders, 0.5) AS median_bidders FROM ba WHERE department <> 'NO_LOCALIZADO' GROUP BY department")
def _by_department(t):
    return ops.single_bidder_by_department(_resolved(t))


_BUYERS = f"{_BASE}, bb AS (SELECT buyer_id, department, {_ONE}, {_AMOUNT}, count(*) >= 15 AS above_minimum FROM ba GROUP BY buyer_id, department)"


@query("single_bidder_by_buyer", _READS, f", {_BUYERS} SELECT * FROM bb")
def _by_buyer(t):
    return ops.single_bidder_by_buyer(_resolved(t))


@query("top_buyers", _READS, f""", {_BUYERS} SELECT * FROM bb WHERE above_minimum
ORDER BY pct_single_bidder DESC, awarded_processes DESC, buyer_id NULLS LAST, department NULLS LAST LIMIT 10""")
def _top_buyers(t):
    return ops.top_buyers(ops.single_bidder_by_buyer(_resolved(t)))


_WINDOW = f"""{_RESOLVE}, wd AS (SELECT *, coalesce(window_days_declared, window_days_computed) AS window_days,
  CASE WHEN window_days_declared IS NOT NULL THEN 'declarado' ELSE 'calculado' END AS window_origin FROM rs),
kw AS (SELECT *, window_days < 3 AS short, awarded AND coalesce(bidders >= 1, false) AS base, coalesce(bidders = 1, false) AS one FROM wd WHERE window_days >= 0)"""


@query("short_window_summary", _READS, f""", {_WINDOW} SELECT count(*) AS with_window, count(*) FILTER (WHERE short) AS short,
{pct('count(*) FILTER (WHERE short)', 'count(*)')} AS pct_short, count(*) FILTER (WHERE base AND short) AS awarded_short,
count(*) FILTER (WHERE base AND NOT short) AS awarded_normal,
{rnd('100.0 * count(*) FILTER (WHERE base AND short AND one) / nullif(count(*) FILTER (WHERE base AND short), 0)', 2)} AS pct_single_short,
{rnd('100.0 * count(*) FILTER (WHERE base AND NOT short AND one) / nullif(count(*) FILTER (WHERE base AND NOT short), 0)', 2)} AS pct_single_normal,
{pct('count(*)', '(SELECT count(*) FROM rs)')} AS pct_with_window, {rnd('quantile_cont(window_days, 0.5)', 1)} AS median_days,
{rnd('quantile_cont(window_days, 0.25)', 1)} AS p25_days FROM kw""")
def _short(t):
    return ops.short_window_summary(_resolved(t))


@query("short_window_rows", _READS, f""", {_WINDOW} SELECT ocid, buyer_id, department, category, amount, window_days, window_origin, bidders, awarded FROM kw WHERE short""")
def _short_rows(t):
    return ops.short_window_rows(_resolved(t))


@query("procurement_overview", _READS, f""", {_FLAGS} SELECT count(*) AS processes, round(coalesce(sum(amount) FILTER (WHERE NOT flag_no_amount), 0), 2) AS amount_total,
count(DISTINCT department) FILTER (WHERE department <> 'NO_LOCALIZADO') AS departments, count(DISTINCT buyer_id) AS buyers,
count(*) FILTER (WHERE awarded) AS awarded FROM fl""")
def _overview(t):
    return ops.overview(_flagged(t)).withColumn("amount_total", F.round("amount_total", 2))


def _dist_sql(by: str, key: str) -> str:
    return f""", {_RESOLVE} SELECT {key} AS {by}, count(*) AS processes, {_AMOUNT}, {rnd('quantile_cont(amount, 0.5)', 0)} AS amount_median
FROM rs WHERE {key} IS NOT NULL GROUP BY 1"""


@query("distribution_by_category", _READS, _dist_sql("category", "category"))
def _dist_category(t):
    return ops.distribution(_resolved(t), "category")


@query("distribution_by_department", _READS, _dist_sql("department", "department"))
def _dist_department(t):
    return ops.distribution(_resolved(t), "department")


@query("distribution_by_month", _READS, _dist_sql("month", "strftime(published, '%Y-%m')"))
def _dist_month(t):
    return ops.distribution(_resolved(t), "month")


@query("largest_tenders", _READS, f", {_BUILD} SELECT ocid, amount FROM pr ORDER BY amount DESC NULLS LAST, ocid LIMIT 500")
def _largest(t):
    return ops.largest(_processes(t).select("ocid", "amount"), RISK.ranking_cap)


@query("category_options", ("tenders",), "SELECT DISTINCT category FROM tenders WHERE category IS NOT NULL")
def _options(t):
    return ops.options(t.tenders, "category")


@query("amount_ceiling", ("tenders",), "SELECT round(quantile_cont(amount, 0.99), 4) AS amount_ceiling FROM tenders")
def _ceiling(t):
    return ops.amount_ceiling(t.tenders).select(F.round("amount_ceiling", 4).alias("amount_ceiling"))


_CONCEPT = "CASE WHEN method = 'Adjudicación Simplificada' THEN '" + NO_EQUIVALENT_CONCEPT + "' " + " ".join(
    f"WHEN method = '{m}' THEN '{METHOD_CONCEPTS[m]}'" for m in ("Licitación Pública", "Contratación Directa", "Subasta Inversa Electrónica")
) + " ELSE method END"


@query("legal_questions", ("tenders",), f"""SELECT ocid, month_file, concat('¿Que dice la Ley sobre ', {_CONCEPT}, '? ¿En que supuestos procede una contratacion', ' por esa via?') AS question,
CASE WHEN method = 'Adjudicación Simplificada' THEN replace('{NO_EQUIVALENT_NOTICE}', '{{metodo}}', method) ELSE '' END AS notice FROM tenders""")
def _questions(t):
    return ops.legal_question(t.tenders).select("ocid", "month_file", "question", "notice")


@query("window_fraction_days", (), """SELECT o_orderkey AS ocid, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 6) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _days(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_orderkey").alias("ocid"), F.round(ops.days_between(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("days"))


@query("choropleth", _READS, f""", {_BASE}, d AS (SELECT department, count(*) AS n FROM ba GROUP BY department)
SELECT n_nationkey, n_name, coalesce(n, 0) AS processes FROM nation LEFT JOIN d ON n_name = department""")
def _choropleth(t):
    values = ops.awarded_base(_resolved(t)).groupBy("department").agg(F.count("*").alias("processes"))
    shapes = t.nation.select("n_nationkey", "n_name", F.lit("").alias("empty_name"))
    return territory.attach_by_name(shapes, ["empty_name", "n_name"], values, "department", {"processes": 0}).drop("empty_name")
