"""Quality rules, tenders, territory, snapshots."""

import pytest
from pyspark.sql import functions as F

from almenara.operators import procurement, quality, snapshots, territory
from almenara.settings import DEPARTMENT_ALIASES, DEPARTMENTS


def test_coordinate_rules(spark):
    rows = [(1, None, "-77"), (2, "0", "-77"), (3, "-77.03", "-12.05"), (4, "45.5", "-77"), (5, "-12.05", "-77.03"),
            (6, "x", "-77"), (7, "-18.4", "-81.4"), (8, "-0.04", "-68.6"), (9, "-0.03", "-70")]
    df = spark.createDataFrame(rows, "id int, lat_raw string, lon_raw string")
    out = {r.id: r for r in quality.validate_coordinates(df).collect()}
    assert [out[i].coord_flags for i in range(1, 10)] == ["R1", "R1", "R3", "R2", "", "R1", "", "", "R2"]
    assert (out[3].lat, out[3].lon, out[3].coord_valid) == (-12.05, -77.03, True)
    kept = {r.id: r for r in quality.validate_coordinates(df, swap=False).collect()}
    assert (kept[3].coord_flags, kept[3].coord_valid, kept[3].lat) == ("R3|R2", False, -77.03)


def test_rule_report_counts_without_deleting(spark):
    df = spark.createDataFrame([("a", 1, "-77.03", "-12.05"), ("a", 2, None, None), ("b", 1, "-12", "-77"), (None, 1, "-12", "-77")],
                               "facility_id string, ord int, lat_raw string, lon_raw string")
    flagged = quality.validate_coordinates(quality.flag_repeats(df, "facility_id", "ord"))
    assert flagged.count() == 4
    out = {r.rule: r for r in quality.rule_report(flagged, quality.supply_rules()).collect()}
    assert [out[c].flagged for c in ("R5", "R1", "R3", "R2")] == [1, 1, 1, 0]
    assert (out["R3"].recovered, out["R3"].pct_recovered, out["R3"].action) == (1, 100.0, "CORREGIDO")
    assert (out["R2"].action, out["R1"].action, out["R1"].pct_flagged) == ("SIN_HALLAZGOS", "RETENIDO", 25.0)
    off = {r.rule: r for r in quality.rule_report(flagged, quality.supply_rules(swap=False)).collect()}
    assert off["R3"].recovered == 0


def test_repeats_keep_the_first_and_copies_mark_all(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1), (None, 2)], "k string, ord int")
    rep = {(r.k, r.ord): r.is_repeat for r in quality.flag_repeats(df, "k", "ord").collect()}
    assert rep == {("a", 1): False, ("a", 2): True, ("a", 3): True, ("b", 1): False, (None, 1): False, (None, 2): True}
    cop = {(r.k, r.ord): r.c for r in quality.flag_copies(df, "k", "c").collect()}
    assert [cop["a", 1], cop["b", 1], cop[None, 2]] == [True, False, True]


def test_text_columns_are_repaired_and_counted(spark):
    df = spark.createDataFrame([("JosÃ©", " a  b "), ("Â¿π", "x"), ("Ana", None)], "n string, m string")
    fixed, counts = quality.repair_text_columns(df, ["n", "m", "absent"])
    assert sorted(map(str, (tuple(r) for r in fixed.collect()))) == sorted(map(str, [("José", "a b"), ("Â¿π", "x"), ("Ana", None)]))
    assert {r.column: (r.flagged, r.repaired) for r in counts.collect()} == {"n": (2, 1), "m": (0, 0)}


def test_domain_check_splits_rows(spark):
    df = spark.createDataFrame([(1, "F", "X"), (2, "?", "Y"), (3, None, "X")], "id int, g string, a string")
    checked = quality.check_domains(df, {"g": ("F", "M"), "a": ("X",)})
    assert [r.id for r in quality.accepted(checked).collect()] == [1]
    bad = {r.id: (r.identifier, r.reason.count(";")) for r in quality.rejects(checked, F.concat(F.lit("ID "), F.col("id").cast("string"))).collect()}
    assert bad == {2: ("ID 2", 1), 3: ("ID 3", 0)}
    assert tuple(quality.run_summary(checked).first()) == (3, 1, 2)


def test_contracts_report_and_stop(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    res = quality.all_contracts(
        quality.expect_unique("unico", df, "id"), quality.expect_rows(df, {"positivo": F.col("id") > 0}),
        quality.expect_keys_in("conocido", df, df.filter("id = 2"), "id"))
    assert {r.contract: (r.violations, r.ok) for r in res.collect()} == {"unico": (1, False), "positivo": (0, True), "conocido": (2, False)}
    with pytest.raises(ValueError, match="unico: 1"):
        quality.enforce(res)
    quality.enforce(res.filter("ok"))


def test_source_verdicts(spark):
    good = "palabra " * 60
    glued = "palabraPegada " * 40
    df = spark.createDataFrame([("ok", 1, good), ("ok", 2, good), ("scan", 1, good), ("scan", 2, ""), ("mix", 1, glued), ("tiny", 1, "x" * 150)],
                               "doc string, page int, text string")
    out = {r.doc: (r.usable, r.order_ok, r.low_pages) for r in quality.check_sources(df).collect()}
    assert out == {"ok": (True, True, 0), "scan": (False, True, 1), "mix": (False, False, 0), "tiny": (False, False, 1)}


def test_urban_rules(spark):
    df = spark.createDataFrame([(1, 2000.0, "villa"), (2, 2000.0, None), (3, 5.0, "Villa"), (4, None, "caserio")], "id int, weight double, category string")
    out = {r.id: (r.is_urban, r.urban_criterion) for r in quality.classify_urban(df, 2000, ("VILLA",)).collect()}
    assert out == {1: (True, "poblacion_y_categoria"), 2: (True, "poblacion>=2000"), 3: (True, "categoria"), 4: (False, "rural")}
    kept, report = quality.minimum_weight(df, 10)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4]
    assert (report.first().rows_lost, report.first().weight_lost) == (1, 5.0)


def test_processes_take_the_latest_month_first_buyer_and_all_awards(spark):
    tenders = spark.createDataFrame([(1, "old", "2026-06"), (1, "new", "2026-07"), (2, "x", "2026-06")], "ocid int, title string, month_file string")
    parties = spark.createDataFrame([(1, 2, "E2", "BUYER"), (1, 1, "E1", "procuringEntity;Buyer"), (2, 1, "E3", "tenderer"), (2, 2, "E4", None)], "ocid int, ord int, entity_id string, roles string")
    awards = spark.createDataFrame([(1, 5.0, "2026-01-01"), (1, None, "2026-02-01"), (9, 1.0, "2026-01-01")], "ocid int, amount double, award_date string")
    out = {r.ocid: r for r in procurement.build_processes(tenders, parties, awards).collect()}
    assert (out[1].title, out[1].entity_id, out[1].awarded_amount, out[1].award_date, out[1].awarded) == ("new", "E1", 5.0, "2026-02-01", True)
    assert (out[2].entity_id, out[2].awarded_amount, out[2].awarded) == (None, None, False)


def test_filters_treat_unknowns_as_the_engine_does(spark):
    df = spark.createDataFrame([(1, "CUSCO", "works", None, None, True), (2, "CUSCO", "works", 50.0, "2026-03-01", True), (3, "PUNO", None, 500.0, "2025-01-01", None)],
                               "id int, department string, category string, amount double, d string, awarded boolean").withColumn("published", F.col("d").cast("timestamp"))

    def ids(f):
        return sorted(r.id for r in df.filter(f.predicate()).collect())

    F_ = procurement.Filters
    assert ids(F_()) == [1, 2, 3]
    assert ids(F_(amount_max=100.0)) == [1, 2]
    assert ids(F_(amount_min=1.0)) == [2, 3]
    assert ids(F_(date_from="2026-01-01")) == [1, 2]
    assert ids(F_(date_to="2026-01-01", awarded_only=True)) == [1]
    assert ids(F_(departments=("PUNO",), categories=("works",))) == []
    kept = procurement.dashboard_filter(df, amount=(100.0, 900.0), dates=("2024-01-01", "2025-12-31"))
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_single_bidder_and_windows(spark):
    rows = [(1, "A", "CUSCO", True, "1", "2", None, 10.0), (2, "A", "CUSCO", True, "3", None, 5.0, None), (3, "B", None, True, "1", "-1", 1.0, 5.0),
            (4, None, "PUNO", False, "1", "9", None, 1.0), (5, "A", "NO_LOCALIZADO", True, "0", None, None, 1.0), (6, "A", "CUSCO", True, None, "1", None, 2.0)]
    df = spark.createDataFrame(rows, "ocid int, buyer_id string, department string, awarded boolean, bidders string, window_days_declared string, window_days_computed double, amount double")
    o = procurement.single_bidder_overall(df).first()
    assert (o.awarded_processes, o.single_bidder, o.pct_single_bidder, o.median_bidders) == (3, 2, 66.67, 1.0)
    assert {r.department: r.single_bidder for r in procurement.single_bidder_by_department(df).collect()} == {"CUSCO": 1}
    b = {(r.buyer_id, r.department): (r.awarded_processes, r.above_minimum) for r in procurement.single_bidder_by_buyer(df, 2).collect()}
    assert b == {("A", "CUSCO"): (2, True), ("B", None): (1, False)}
    assert [r.buyer_id for r in procurement.top_buyers(procurement.single_bidder_by_buyer(df, 2)).collect()] == ["A"]
    w = procurement.short_window_summary(df).first()
    assert (w.with_window, w.short, w.awarded_short, w.awarded_normal, w.pct_single_short, w.pct_single_normal) == (4, 2, 1, 1, 100.0, 0.0)
    assert {r.ocid: r.window_origin for r in procurement.short_window_rows(df).collect()} == {1: "declarado", 6: "declarado"}


def test_tender_flags(spark):
    df = spark.createDataFrame([
        (1, "12", "Compra de equipos", "LIMA", "Junín", "JUNIN", "2026-01-01"), (1, "0", "corto", "Comas", "LIMA", "LIMA", "no"),
        (2, None, None, None, None, "NO_LOCALIZADO", None)],
        "ocid int, amount string, description string, locality_raw string, department_raw string, department string, published string")
    out = sorted(procurement.flag_tenders(df).collect(), key=lambda r: (r.ocid, r.flag_no_amount))
    assert [r.flag_duplicate for r in out] == [True, True, False]
    assert [r.flag_no_amount for r in out] == [False, True, True]
    assert [r.flag_no_description for r in out] == [False, True, True]
    assert [r.flag_locality_not_department for r in out] == [False, True, False]
    assert [r.flag_spelling for r in out] == [True, False, False]
    assert [r.flag_no_date for r in out] == [False, True, True]
    assert [r.fit_for_map for r in out] == [True, True, False]


def test_cascade_uses_each_step_in_order(spark):
    rows = [(1, "E1", "Junín", None, None), (2, "E1", None, "Cuzco", None), (3, "E1", None, None, "Lima"), (4, "E2", "??", None, "LAMBAYEQUES"),
            (5, None, None, None, "zzz"), (6, "E1", "JUNIN", None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, entity_id string, department_raw string, region_raw string, locality_raw string")
    res = territory.resolve_departments(df, DEPARTMENTS, DEPARTMENT_ALIASES)
    out = {r.id: (r.department, r.department_origin) for r in res.collect()}
    assert out == {1: ("JUNIN", "campo_departamento"), 2: ("CUSCO", "campo_region"), 3: ("JUNIN", "imputado_por_entidad"),
                   4: ("LAMBAYEQUE", "fuzzy_localidad"), 5: ("NO_LOCALIZADO", "no_localizado"), 6: ("JUNIN", "campo_departamento"),
                   7: ("NO_LOCALIZADO", "no_localizado")}
    rep = {r.step: (r.rows, r.pct) for r in territory.recovery_report(res).collect()}
    assert rep["TOTAL_LOCALIZADOS"] == (5, 71.43) and rep["5_no_localizado"] == (2, 28.57)


def test_cascade_with_no_entity_on_most_rows(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 == 0, "E").alias("entity_id"), F.when(F.col("id") == 0, "Lima").alias("department_raw"),
        F.lit(None).cast("string").alias("region_raw"), F.when(F.col("id") % 10 == 1, "PIURAA").alias("locality_raw"),
    )
    out = territory.resolve_departments(df, DEPARTMENTS, DEPARTMENT_ALIASES).groupBy("department", "department_origin").count().collect()
    assert {tuple(r) for r in out} == {("LIMA", "campo_departamento", 1), ("LIMA", "imputado_por_entidad", 299), ("PIURA", "fuzzy_localidad", 300), ("NO_LOCALIZADO", "no_localizado", 2400)}


def test_legal_questions(spark):
    df = spark.createDataFrame([("Adjudicación Simplificada", "goods"), ("Subasta Inversa Electrónica", "Works"), ("Nuevo", None)], "method string, category string")
    out = {r.method: r for r in procurement.legal_question(df).collect()}
    assert "competitivos y no competitivos?" in out["Adjudicación Simplificada"].question and " de bienes por" in out["Adjudicación Simplificada"].question
    assert "«Adjudicación Simplificada»" in out["Adjudicación Simplificada"].notice
    assert out["Subasta Inversa Electrónica"].question.startswith("¿Que dice la Ley sobre subasta inversa electrónica?") and " de obras" in out["Subasta Inversa Electrónica"].question
    assert "sobre Nuevo?" in out["Nuevo"].question and out["Nuevo"].notice == ""


def test_snapshot_comparison(spark):
    schema = "facility_id int, category string, state string, resolutive boolean"
    before = spark.createDataFrame([(1, "I-4", "ACTIVO", False), (2, "II-1", "ACTIVO", True), (3, "I-1", "ACTIVO", False)], schema)
    now = spark.createDataFrame([(1, "II-1", "ACTIVO", True), (2, "II-1", "CIERRE", False), (4, "II-1", "ACTIVO", True)], schema)
    out = {r.indicator: r.value for r in snapshots.compare_snapshots(now, before).collect()}
    assert list(out.values()) == [3, 3, 1, 1, 1, 1, 1, 2, 1, 1]
    assert {r.facility_id: r.membership for r in snapshots.key_sets(now, before).collect()} == {1: "comun", 2: "comun", 3: "baja", 4: "alta"}


def test_map_values_join_by_normalised_name(spark):
    shapes = spark.createDataFrame([(1, "", "Junín"), (2, "CUSCO", "x"), (3, None, "Puno")], "id int, a string, b string")
    values = spark.createDataFrame([("JUNIN", 5), ("Cusco", 7)], "department string, n int")
    out = {r.id: r["n"] for r in territory.attach_by_name(shapes, ["a", "b"], values, "department", {"n": 0}).collect()}
    assert out == {1: 5, 2: 7, 3: 0}


def test_rows_that_need_no_partner_are_dealt_over_all_tasks(spark):
    """Rows with a known department carry no key into the joins of the cascade; they must not crowd one partition."""
    rows = spark.range(4000).selectExpr("id", "if(id % 100 = 0, id, null) AS key")
    found = spark.range(0, 4000, 100).selectExpr("id AS _on", "id AS value")
    auto, adaptive = (spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = territory._join_open(rows, found, F.col("key").isNotNull(), F.col("key"))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert out.filter("value IS NOT NULL").count() == 40 and out.filter("value = key").count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(sizes) == 4000 and max(sizes) < 1500
