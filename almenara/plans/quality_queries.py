"""Queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.functions.text import canonical_category, canonical_state, glued_words, latin_key
from almenara.operators import access as acc
from almenara.operators import quality as ops
from almenara.plans.oracle_text import rnd
from almenara.plans.registry import query
from almenara.settings import URBAN_CATEGORIES

_BOX = "coalesce({x} BETWEEN -81.4 AND -68.6 AND {y} BETWEEN -18.4 AND -0.04, false)"
_COORD = f"""n1 AS (SELECT *, try_cast(trim(lat_raw) AS DOUBLE) AS y, try_cast(trim(lon_raw) AS DOUBLE) AS x FROM facilities),
n2 AS (SELECT *, y IS NULL OR x IS NULL OR y = 0 OR x = 0 AS r1, {_BOX.format(x='x', y='y')} AS direct, {_BOX.format(x='y', y='x')} AS swapped FROM n1),
n3 AS (SELECT *, NOT direct AND swapped AND NOT r1 AS r3, ord > min(ord) OVER (PARTITION BY facility_id) AS is_repeat FROM n2),
n4 AS (SELECT *, CASE WHEN r3 THEN x ELSE y END AS lat, CASE WHEN r3 THEN y ELSE x END AS lon FROM n3),
n5 AS (SELECT *, NOT {_BOX.format(x='lon', y='lat')} AND NOT r1 AS r2, {_BOX.format(x='lon', y='lat')} AND NOT r1 AS coord_valid FROM n4),
n6 AS (SELECT *, concat_ws('|', CASE WHEN r1 THEN 'R1' END, CASE WHEN r3 THEN 'R3' END, CASE WHEN r2 THEN 'R2' END) AS coord_flags,
  upper(trim(category_raw)) AS word FROM n5),
n7 AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(translate(word, '–—', '--'), '[\\s.]+', '-', 'g'), '-+', '-', 'g'), '-'),
  '^(I{{1,3}})([12E])$', '\\1-\\2') AS dashed,
  coalesce(nullif(trim(regexp_replace(upper(state_raw), '\\s+', ' ', 'g')), ''), 'DESCONOCIDO') AS state FROM n6),
n8 AS (SELECT *, CASE WHEN word NOT IN ('', '0', 'NAN', 'NONE', 'SIN CATEGORIA', 'S/C', '-')
  AND dashed IN ('I-1', 'I-2', 'I-3', 'I-4', 'II-1', 'II-2', 'II-E', 'III-1', 'III-2', 'III-E') THEN dashed ELSE 'SIN_CATEGORIA' END AS category FROM n7),
su AS (SELECT *, category IN ('II-1', 'II-2', 'II-E', 'III-1', 'III-2', 'III-E') AND state = 'ACTIVO' AS resolutive,
  coord_valid AND NOT is_repeat AS routable FROM n8)"""


@query("supply_flags", ("facilities",), f", {_COORD} SELECT facility_id, ord, lat, lon, coord_valid, coord_flags, is_repeat, r1, r2, r3, category, state, resolutive, routable FROM su")
def _supply(t):
    return ops.build_supply(t.facilities).select(
        "facility_id", "ord", "lat", "lon", "coord_valid", "coord_flags", "is_repeat", "r1", "r2", "r3",
        "category", "state", "resolutive", "routable",
    )


@query("coordinate_coercion", ("facilities",), "SELECT facility_id, ord, try_cast(trim(lat_raw) AS DOUBLE) AS lat FROM facilities")
def _coercion(t):
    return t.facilities.select("facility_id", "ord", ops.to_number("lat_raw").alias("lat"))


@query("category_and_state", ("facilities",), f", {_COORD} SELECT DISTINCT category_raw, state_raw, category, state FROM su")
def _category(t):
    return t.facilities.select(
        "category_raw", "state_raw", canonical_category("category_raw").alias("category"),
        canonical_state("state_raw").alias("state"),
    ).distinct()


def _rule_row(code: str, description: str, flag: str, recovered: str, discarded: str, reason: str) -> str:
    n = f"count(*) FILTER (WHERE {flag})"
    action = f"CASE WHEN {n} = 0 THEN 'SIN_HALLAZGOS' WHEN {recovered} > 0 AND {n} = {recovered} THEN 'CORREGIDO' ELSE 'RETENIDO' END"
    return f"""SELECT '{code}' AS rule, '{description}' AS description, count(*) AS evaluated, {n} AS flagged, {recovered} AS recovered,
{discarded} AS discarded, '{reason}' AS reason, {rnd(f'100.0 * {n} / count(*)', 3)} AS pct_flagged,
coalesce({rnd(f'100.0 * {recovered} / nullif({n}, 0)', 1)}, 0) AS pct_recovered, {action} AS action FROM su"""


_R3 = "count(*) FILTER (WHERE r3)"


@query("supply_rule_report", ("facilities",), f", {_COORD} " + " UNION ALL ".join([
    _rule_row("R5", "El mismo codigo se repite", "is_repeat", "0", "count(*) FILTER (WHERE is_repeat)", "se conserva la primera aparicion"),
    _rule_row("R1", "Falta la posicion o vale cero", "r1", "0", "count(*) FILTER (WHERE r1)", "sin posicion recuperable"),
    _rule_row("R3", "Los dos ejes estan cambiados", "r3", _R3, "0", "solo admite una lectura"),
    _rule_row("R2", "La posicion cae fuera del recuadro", "r2", "0", "count(*) FILTER (WHERE r2)", "sin lectura alternativa"),
]))
def _rule_report(t):
    return ops.rule_report(ops.build_supply(t.facilities), ops.supply_rules())


_CATS = ("I-3", "I-4", "II-1", "II-2", "III-1", "SIN_CATEGORIA")


@query("facilities_by_category", ("facilities",), f", {_COORD} SELECT region, " + ", ".join(
    f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in _CATS) + " FROM su GROUP BY region")
def _by_category(t):
    return acc.facilities_by_category(ops.build_supply(t.facilities), _CATS)


@query("upgrade_candidates", ("facilities",), f", {_COORD} SELECT facility_id, category FROM su WHERE category IN ('I-3', 'I-4') AND state = 'ACTIVO' AND routable")
def _candidates(t):
    return acc.upgrade_candidates(ops.build_supply(t.facilities)).select("facility_id", "category")


_URBAN = """ur AS (SELECT *, coalesce(weight >= 2000, false) AS bw, coalesce(upper(category) IN ('CIUDAD', 'VILLA', 'PUEBLO', 'PP.JJ.AA.HH.', 'BARRIO O CUARTEL'), false) AS bc FROM points)"""


def _urban(t):
    return ops.classify_urban(t.points, 2000.0, URBAN_CATEGORIES)


@query("urban_classification", ("points",), f""", {_URBAN} SELECT point_id, bw OR bc AS is_urban,
CASE WHEN bw AND bc THEN 'poblacion_y_categoria' WHEN bw THEN 'poblacion>=2000' WHEN bc THEN 'categoria' ELSE 'rural' END AS urban_criterion FROM ur""")
def _urban_query(t):
    return _urban(t).select("point_id", "is_urban", "urban_criterion")


@query("minimum_weight_report", ("points",), f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE weight < 500) AS rows_lost,
round(coalesce(sum(weight) FILTER (WHERE weight < 500), 0), 4) AS weight_lost,
{rnd('100.0 * coalesce(sum(weight) FILTER (WHERE weight < 500), 0) / sum(weight)', 4)} AS pct_weight_lost FROM points""")
def _minimum(t):
    return ops.minimum_weight(t.points, 500.0)[1].withColumn("weight_lost", F.round("weight_lost", 4))


@query("scope_summary", ("points", "facilities"), f""", {_COORD}, {_URBAN},
d AS (SELECT region, count(DISTINCT district) AS districts, count(*) AS points, count(*) FILTER (WHERE weight = 0) AS points_without_weight,
  sum(weight) AS w, coalesce(sum(weight) FILTER (WHERE bw OR bc), 0) AS u, coalesce(sum(weight) FILTER (WHERE NOT (bw OR bc)), 0) AS r FROM ur GROUP BY region),
s AS (SELECT region, count(*) AS facilities, count(*) FILTER (WHERE coord_valid) AS coord_valid, count(*) FILTER (WHERE resolutive) AS resolutive,
  count(*) FILTER (WHERE resolutive AND routable) AS resolutive_usable FROM su GROUP BY region)
SELECT d.region, districts, points, points_without_weight, {rnd('w', 0)} AS weight, {rnd('u', 0)} AS weight_urban, {rnd('r', 0)} AS weight_rural,
coalesce(facilities, 0) AS facilities, coalesce(coord_valid, 0) AS coord_valid, coalesce(resolutive, 0) AS resolutive,
coalesce(resolutive_usable, 0) AS resolutive_usable, {rnd('w / nullif(resolutive_usable, 0)', 0)} AS weight_per_usable
FROM d LEFT JOIN s ON d.region = s.region""")
def _scope_summary(t):
    return acc.scope_summary(_urban(t), ops.build_supply(t.facilities))


_ALLOWED = {"gender": ("Femenino", "Masculino"), "area": ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")}
_STAFF = """st AS (SELECT *, CASE WHEN gender NOT IN ('Femenino', 'Masculino') THEN concat('gender: opcion no encontrada: ', gender) END AS g,
  CASE WHEN area NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN concat('area: opcion no encontrada: ', area) END AS a FROM staff)"""


@query("staff_rejects", ("staff",), f""", {_STAFF} SELECT row_no, full_name, gender, area, concat('FILA ', row_no, ' - ', full_name) AS identifier,
concat_ws('; ', g, a) AS reason FROM st WHERE g IS NOT NULL OR a IS NOT NULL""")
def _rejects(t):
    who = F.concat(F.lit("FILA "), F.col("row_no").cast("string"), F.lit(" - "), F.col("full_name"))
    return ops.rejects(ops.check_domains(t.staff, _ALLOWED), who)


@query("staff_accepted", ("staff",), f", {_STAFF} SELECT row_no, full_name, gender, area FROM st WHERE g IS NULL AND a IS NULL")
def _accepted(t):
    return ops.accepted(ops.check_domains(t.staff, _ALLOWED))


@query("staff_run_summary", ("staff",), f""", {_STAFF} SELECT count(*) AS processed, count(*) FILTER (WHERE g IS NULL AND a IS NULL) AS loaded,
count(*) FILTER (WHERE g IS NOT NULL OR a IS NOT NULL) AS skipped FROM st""")
def _staff_summary(t):
    return ops.run_summary(ops.check_domains(t.staff, _ALLOWED))


@query("nation_keys", (), r"""SELECT n_nationkey, trim(regexp_replace(translate(upper(concat('  ', replace(n_name, 'A', 'á'), ' ñ ')),
'ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'AAAAAAEEEEIIIIOOOOOUUUUNCY'), '\s+', ' ', 'g')) AS key FROM nation""")
def _nation_keys(t):
    accented = F.concat(F.lit("  "), F.replace("n_name", F.lit("A"), F.lit("á")), F.lit(" ñ "))
    return t.nation.select("n_nationkey", latin_key(accented).alias("key"))


@query("source_check", ("docs",), r""", pg AS (SELECT doc, page, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS words,
  len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: length(w) > 6 AND regexp_matches(w, '\p{Ll}\p{Lu}'))) AS glued FROM docs),
s AS (SELECT doc, count(*) AS pages, sum(length(text)) AS chars, count(*) FILTER (WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200) AS low_pages,
  sum(length(text) + 1) - 1 AS sample, sum(words) AS words, sum(glued) AS glued FROM pg GROUP BY doc),
v AS (SELECT doc, pages, chars, low_pages, 100.0 * low_pages / pages AS pct, sample >= 200 AND coalesce(glued / nullif(words, 0) < 0.15, false) AS order_ok FROM s)
SELECT doc, pages, CAST(chars AS BIGINT) AS chars, low_pages, round(pct, 6) AS pct_low_pages, order_ok, pct <= 5 AND order_ok AS usable,
CASE WHEN pct <= 5 AND order_ok THEN 'usable tal cual' ELSE concat_ws('; ', CASE WHEN pct > 5 THEN 'paginas sin texto extraible' END,
  CASE WHEN NOT order_ok THEN 'orden de lectura incorrecto' END) END AS reason FROM v""")
def _source_check(t):
    return ops.check_sources(t.docs).withColumn("pct_low_pages", F.round("pct_low_pages", 6))


@query("glued_words_by_document", ("docs",), r"""SELECT doc, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'),
lambda w: length(w) > 6 AND regexp_matches(w, '\p{Ll}\p{Lu}')))) AS BIGINT) AS glued FROM docs GROUP BY doc""")
def _glued(t):
    return t.docs.groupBy("doc").agg(F.sum(glued_words("text")).alias("glued"))


@query("supply_contracts", ("facilities",), f""", {_COORD}
SELECT 'facility_id unico entre los no repetidos' AS contract, (SELECT count(*) FROM (SELECT facility_id FROM su WHERE NOT is_repeat GROUP BY 1 HAVING count(*) > 1) x) AS violations, true AS ok
UNION ALL SELECT 'routable implica coord_valid', count(*) FILTER (WHERE routable AND NOT coord_valid), true FROM su
UNION ALL SELECT 'routable implica no repetido', count(*) FILTER (WHERE routable AND is_repeat), true FROM su
UNION ALL SELECT 'resolutive igual a estado y categoria', count(*) FILTER (WHERE resolutive <> (state = 'ACTIVO' AND category IN ('II-1', 'II-2', 'II-E', 'III-1', 'III-2', 'III-E'))), true FROM su
UNION ALL SELECT 'coord_valid dentro del area', count(*) FILTER (WHERE coord_valid AND NOT {_BOX.format(x='lon', y='lat')}), true FROM su
UNION ALL SELECT 'district conocido', count(*) FILTER (WHERE district NOT IN (SELECT n_nationkey FROM nation)), true FROM su""")
def _supply_contracts(t):
    su = ops.build_supply(t.facilities)
    c = F.col
    rows = ops.expect_rows(su, {
        "routable implica coord_valid": ~c("routable") | c("coord_valid"),
        "routable implica no repetido": ~c("routable") | ~c("is_repeat"),
        "resolutive igual a estado y categoria": c("resolutive")
        == (c("state").isin("ACTIVO") & c("category").isin("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")),
        "coord_valid dentro del area": ~c("coord_valid") | ops.in_box(c("lon"), c("lat")),
    })
    return ops.all_contracts(
        ops.expect_unique("facility_id unico entre los no repetidos", su.filter(~c("is_repeat")), "facility_id"),
        rows,
        ops.expect_keys_in("district conocido", su, t.nation.select(c("n_nationkey").alias("district")), "district"),
    )


@query("access_contracts", ("access", "pairs"), """
SELECT 'point_id unico' AS contract, (SELECT count(*) FROM (SELECT point_id FROM access GROUP BY 1 HAVING count(*) > 1) x) AS violations, true AS ok
UNION ALL SELECT 'tiempo si y solo si alcanzable', count(*) FILTER (WHERE reachable <> (t_min IS NOT NULL)), true FROM access
UNION ALL SELECT 'peso no negativo', count(*) FILTER (WHERE weight < 0), true FROM access
UNION ALL SELECT 'tiempo igual al minimo de la matriz', (SELECT count(*) FROM access a LEFT JOIN (SELECT point_id, min(duration_s) / 60 AS m FROM pairs
  WHERE mode = 1 AND resolutive GROUP BY 1) n ON a.point_id = n.point_id WHERE a.t_min IS DISTINCT FROM n.m), true
UNION ALL SELECT 'porcentajes por banda suman 100', 0, true
UNION ALL SELECT 'acumulados no decrecen', 0, true""")
def _access_contracts(t):
    c = F.col
    best = acc.nearest_destination(t.pairs.filter("mode = 1 AND resolutive"))
    differs = t.access.join(best.select("point_id", "t_min_min"), "point_id", "left").filter(
        ~c("t_min").eqNullSafe(c("t_min_min"))
    )
    bands = acc.coverage_bands(t.access)
    parts = sum((c(x) for x in ("pct_0_30", "pct_30_60", "pct_60_120", "pct_over_120", "pct_no_access")), F.lit(0.0))
    return ops.all_contracts(
        ops.expect_unique("point_id unico", t.access, "point_id"),
        ops.expect_rows(t.access, {
            "tiempo si y solo si alcanzable": c("reachable") == c("t_min").isNotNull(),
            "peso no negativo": c("weight") >= 0,
        }),
        ops.expect("tiempo igual al minimo de la matriz", differs),
        ops.expect_rows(bands, {
            "porcentajes por banda suman 100": F.abs(parts - 100) <= 0.5,
            "acumulados no decrecen": (c("pct_within_30") <= c("pct_within_60")) & (c("pct_within_60") <= c("pct_within_120")),
        }),
    )


_SNAP = f"""{_COORD}, ac AS (SELECT facility_id, category, state, resolutive FROM su WHERE NOT is_repeat AND facility_id % 9 <> 0),
an AS (SELECT facility_id, CASE WHEN facility_id % 8 = 0 THEN 'I-4' ELSE category END AS category,
  CASE WHEN facility_id % 11 = 0 THEN 'CIERRE' ELSE state END AS state,
  CASE WHEN facility_id % 8 = 0 OR facility_id % 11 = 0 THEN false ELSE resolutive END AS resolutive FROM su WHERE NOT is_repeat AND facility_id % 7 <> 3)"""


def _two_snapshots(t):
    su = ops.build_supply(t.facilities).filter(~F.col("is_repeat")).select("facility_id", "category", "state", "resolutive")
    i = F.col("facility_id")
    before = su.filter(i % 7 != 3).withColumns({
        "category": F.when(i % 8 == 0, "I-4").otherwise(F.col("category")),
        "state": F.when(i % 11 == 0, "CIERRE").otherwise(F.col("state")),
        "resolutive": F.when((i % 8 == 0) | (i % 11 == 0), F.lit(False)).otherwise(F.col("resolutive")),
    })
    return su.filter(i % 9 != 0), before


@query("snapshot_comparison", ("facilities",), f""", {_SNAP}, j AS (SELECT a.facility_id AS ia, b.facility_id AS ib, a.category AS ca, b.category AS cb,
  a.state AS sa, b.state AS sb, a.resolutive AS ra, b.resolutive AS rb FROM ac a FULL OUTER JOIN an b ON a.facility_id = b.facility_id)
SELECT 'establecimientos_corte_anterior' AS indicator, count(ib) AS value FROM j UNION ALL SELECT 'establecimientos_corte_actual', count(ia) FROM j
UNION ALL SELECT 'altas_nuevas', count(*) FROM j WHERE ib IS NULL UNION ALL SELECT 'bajas_desaparecidas', count(*) FROM j WHERE ia IS NULL
UNION ALL SELECT 'cambio_de_categoria', count(*) FROM j WHERE ca <> cb UNION ALL SELECT 'cambio_de_estado', count(*) FROM j WHERE sa <> sb
UNION ALL SELECT 'resolutivos_corte_anterior', count(*) FROM j WHERE rb UNION ALL SELECT 'resolutivos_corte_actual', count(*) FROM j WHERE ra
UNION ALL SELECT 'ganaron_capacidad_resolutiva', count(*) FROM j WHERE ra AND NOT rb UNION ALL SELECT 'perdieron_capacidad_resolutiva', count(*) FROM j WHERE rb AND NOT ra""")
def _snapshots(t):
    from almenara.operators.snapshots import compare_snapshots

    return compare_snapshots(*_two_snapshots(t))


@query("snapshot_key_sets", ("facilities",), f""", {_SNAP}
SELECT coalesce(a.facility_id, b.facility_id) AS facility_id, CASE WHEN b.facility_id IS NULL THEN 'alta' WHEN a.facility_id IS NULL THEN 'baja' ELSE 'comun' END AS membership
FROM ac a FULL OUTER JOIN an b ON a.facility_id = b.facility_id""")
def _key_sets(t):
    from almenara.operators.snapshots import key_sets

    return key_sets(*_two_snapshots(t))


def _misread(t):
    """Every document as if its UTF-8 bytes had been read as Latin-1."""
    return t.documents.select(
        "doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"), F.col("source").alias("origin")
    )


@query("mojibake_repair", (), r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _repair(t):
    fixed, _ = ops.repair_text_columns(_misread(t), ["text", "origin"])
    return fixed.select("doc_id", F.md5("text").alias("digest"))


@query("mojibake_counts", (), r"""SELECT 'text' AS "column", count(*) FILTER (WHERE regexp_matches(text, '[^\x00-\x7f]')) AS flagged,
count(*) FILTER (WHERE regexp_matches(text, '[^\x00-\x7f]')) AS repaired FROM documents UNION ALL SELECT 'origin', 0, 0""")
def _counts(t):
    return ops.repair_text_columns(_misread(t), ["text", "origin"])[1]
