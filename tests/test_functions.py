"""Scalar functions on hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from almenara.functions import numeric, text
from almenara.operators import costs, documents, retrieval, territory
from almenara.operators.procurement import Filters, days_between


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, fixed", [
    ("JosÃ©", "José"), ("José", "José"), ("π", "π"), ("CAÃ‘ON", "CAÃ‘ON"), ("", ""), (None, None), ("plain", "plain"),
])
def test_mojibake_is_repaired_only_when_it_helps(spark, raw, fixed):
    assert one(spark, raw, text.repair_mojibake) == fixed


@pytest.mark.parametrize("raw, found", [("JosÃ©", True), ("Â¿que?", True), ("â€œ", True), ("ï»¿COD", True), ("a�b", True), ("José", False), (None, False)])
def test_mojibake_signatures(spark, raw, found):
    assert one(spark, raw, text.has_mojibake) is found


@pytest.mark.parametrize("raw, canon", [
    ("ii - 2", "II-2"), ("III1", "III-1"), ("0", "SIN_CATEGORIA"), ("I.3", "I-3"), ("II–E", "II-E"), (None, "SIN_CATEGORIA"),
    ("", "SIN_CATEGORIA"), ("IV-1", "SIN_CATEGORIA"), (" -i-1- ", "I-1"), ("S/C", "SIN_CATEGORIA"), ("II--1", "II-1"),
])
def test_categories(spark, raw, canon):
    assert one(spark, raw, text.canonical_category) == canon


@pytest.mark.parametrize("raw, state", [(" cierre   temporal ", "CIERRE TEMPORAL"), ("", "DESCONOCIDO"), (None, "DESCONOCIDO"), ("activo", "ACTIVO")])
def test_states(spark, raw, state):
    assert one(spark, raw, text.canonical_state) == state


def test_text_forms(spark):
    assert one(spark, "  a \t b\n", text.clean_text) == "a b"
    assert one(spark, "é", text.clean_text) == "é"
    assert one(spark, "ﬁn ½", text.nfkc) == "fin 1⁄2"
    assert one(spark, " Junín  alto ñ", text.text_key) == "JUNIN ALTO N"
    assert one(spark, None, text.text_key) == ""
    assert one(spark, "Junín", text.latin_key) == "JUNIN"


@pytest.mark.parametrize("raw, number", [("-12.05", -12.05), (" 7 ", 7.0), ("n/a", None), ("", None), (None, None), ("#N/D", None)])
def test_numbers(spark, raw, number):
    assert one(spark, raw, numeric.to_number) == number


@pytest.mark.parametrize("value, decimals, out", [(2.5, 0, 2.0), (3.5, 0, 4.0), (3.125, 2, 3.12), (0.1 + 0.2, 1, 0.3), (-2.5, 0, -2.0)])
def test_half_to_even(spark, value, decimals, out):
    assert one(spark, value, lambda c: numeric.rounded(c, decimals), "double") == pytest.approx(out, abs=1e-12)


def test_p_values():
    # t = 2.228 with 10 degrees of freedom leaves 5 % in both tails.
    r = 2.2281388519649385 / (2.2281388519649385**2 + 10) ** 0.5
    assert numeric.correlation_p_value(r, 12) == pytest.approx(0.05, abs=1e-9)
    assert numeric.correlation_p_value(0.0, 30) == pytest.approx(1.0)
    assert numeric.correlation_p_value(1.0, 30) == 0.0
    assert numeric.correlation_p_value(0.5, 2) is None


@pytest.mark.parametrize("ts, tokens, band, cost", [
    ("2026-09-20 07:53:08", (1644, 0, 147), "valle", 0.0003348),
    ("2026-09-22 02:18:15", (2096, 0, 512), "pico", 0.0012432),
    ("2026-09-22 02:19:42", (2096, 1920, 586), "pico", 0.00076752),
    ("2026-09-22 04:00:00", (0, 0, 0), "valle", 0.0),
    ("2026-09-22 06:00:00", (10, 20, 0), "pico", 1.2e-07),
])
def test_call_costs(spark, ts, tokens, band, cost):
    df = spark.createDataFrame([(ts, *tokens, 1.0)], "t string, tokens_in long, tokens_hit long, tokens_out long, latency_s double")
    r = costs.add_costs(df.withColumn("ts", F.col("t").cast("timestamp"))).first()
    assert (r.band, r.cost_usd) == (band, pytest.approx(cost, abs=1e-12))


def test_price_table(spark):
    out = {(r.band, r["item"]): r.usd_per_million for r in costs.price_table(spark).collect()}
    assert len(out) == 6 and out["pico", "salida"] == 1.2 and out["valle", "entrada_cache_hit"] == 0.003


@pytest.mark.parametrize("cell, pages", [("3;4,5", [3, 4, 5]), ("", []), (None, []), ("x; 7 ;7", [7])])
def test_page_sets(spark, cell, pages):
    assert one(spark, cell, retrieval.page_set) == pages


def test_expected_page_tolerance(spark):
    df = spark.createDataFrame([("a", 4, "a", [5]), ("a", 7, "a", [5]), ("b", 5, "a", [5]), ("a", 5, "a", [])], "d string, p int, w string, ps array<int>")
    hit = retrieval.on_expected_page(F.col("d"), F.col("p"), F.col("w"), F.col("ps"))
    assert [r.h for r in df.select(hit.alias("h")).collect()] == [True, False, False, False]


def test_fragment_ids_follow_position_and_text(spark):
    df = spark.createDataFrame([("ley", 7, 2, "texto")], "d string, p int, n int, t string")
    out = df.select(documents.fragment_id(F.col("d"), F.col("p"), F.col("n"), F.col("t")).alias("i")).first().i
    assert out == "ley::p0007::c002::" + __import__("hashlib").sha1(b"texto").hexdigest()[:10]


def test_days_between_are_fractions(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-01-02T12:00:00Z"), ("bad", "2026-01-02")], "a string, b string")
    assert [r.d for r in df.select(days_between(F.col("a"), F.col("b")).alias("d")).collect()] == [1.5, None]


def test_filter_description():
    assert Filters().description() == "ninguno"
    f = Filters(departments=("CUSCO", "PUNO"), amount_min=1500.0, date_from="2026-01-01", awarded_only=True)
    assert f.description() == "departamento en CUSCO, PUNO; monto >= 1,500 PEN; desde 2026-01-01; solo adjudicados"


# Text, name, and their share as 200 * common / (sum of lengths), the common subsequence counted by hand.
SHARES = [
    ("PIURAA", "PIURA", 5, 11), ("PIURA", "PIURA", 5, 10), ("PIRUA", "PIURA", 4, 10), ("PUIRA", "PIURA", 4, 10), ("PURA", "PIURA", 4, 9), ("PI", "PIURA", 2, 7),
    ("LAMBAYEQE", "LAMBAYEQUE", 9, 19), ("LANBAYEQUE", "LAMBAYEQUE", 9, 20), ("CUZCO", "CUSCO", 4, 10), ("CUSC", "CUSCO", 4, 9), ("OCSUC", "CUSCO", 3, 10),
    ("TACMA", "TACNA", 4, 10), ("TACNAA", "TACNA", 5, 11), ("ANCAHS", "ANCASH", 5, 12), ("ANKASH", "ANCASH", 5, 12), ("HANCASH", "ANCASH", 6, 13), ("PUNA", "PUNO", 3, 8),
    ("ONUP", "PUNO", 1, 8), ("LIMAA", "LIMA", 4, 9), ("LMIA", "LIMA", 3, 8), ("AMIL", "LIMA", 1, 8), ("ICCA", "ICA", 3, 7), ("IKA", "ICA", 2, 6), ("XYZ", "ICA", 0, 6),
    ("JUNIM", "JUNIN", 4, 10), ("JUMIN", "JUNIN", 4, 10), ("LORETTO", "LORETO", 6, 13), ("LORTEO", "LORETO", 5, 12), ("UCAYALY", "UCAYALI", 6, 14), ("UKAYALI", "UCAYALI", 6, 14),
    ("TUMBEZ", "TUMBES", 5, 12), ("LIBERTAD LA", "LA LIBERTAD", 8, 22),
]


@pytest.mark.parametrize("a, b, common, both", SHARES)
def test_shares_of_names(a, b, common, both):
    assert territory.share(a, b) == territory.share(b, a) == pytest.approx(200 * common / both)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_match(a, b):
    share = lambda x, y: 200 * plain_common(x, y) / (len(x) + len(y)) if x or y else 0.0

    def part(x, y):
        ways = [(s, t) for s, t in ((x, y), (y, x)) if 0 < len(s) <= len(t)]
        return max((share(s, t[max(0, e - len(s)) : e]) for s, t in ways for e in range(1, len(s) + len(t))), default=0.0)

    order = lambda x: " ".join(sorted(x.split()))
    unique = lambda x: " ".join(sorted(set(x.split())))
    one, two = set(a.split()), set(b.split())
    both = " ".join(sorted(one & two))
    if both and (one <= two or two <= one):
        sets = 100.0
    elif both:
        left, right = (" ".join(sorted(x - y)) for x, y in ((one, two), (two, one)))
        whole = 2 * len(both) + len(left) + len(right) + 2
        sets = max(100 * (1 - (len(left) + len(right) - 2 * plain_common(left, right)) / whole), share(both, f"{both} {left}"), share(both, f"{both} {right}"))
    else:
        sets = share(unique(a), unique(b))
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    if ratio < 1.5:
        return max(share(a, b), 0.95 * max(share(order(a), order(b)), sets))
    weight = 0.9 if ratio <= 8 else 0.6
    words = 100.0 if both else max(part(order(a), order(b)), part(unique(a), unique(b)))
    return max(share(a, b), weight * part(a, b), 0.95 * weight * words)


@pytest.mark.parametrize("name", ["MADRE DE DIOS", "SAN MARTIN", "ICA", "LA LIBERTAD LA"])
def test_match_scores_by_a_plain_version(name):
    rng = random.Random(len(name))
    pool = name.split() + ["DE", "SAM", "MARTINEZ", "DIO", "X", "LIBERTA", "PROVINCIA"]
    texts = {" ".join(rng.choices(pool, k=rng.randint(1, 5))) for _ in range(40)} | {"".join(rng.choices(name.replace(" ", ""), k=rng.randint(1, 30))) for _ in range(20)}
    assert {t: territory.match_score(t, name) for t in texts} == pytest.approx({t: plain_match(t, name) for t in texts})


def test_department_names(spark):
    from almenara.settings import DEPARTMENT_ALIASES, DEPARTMENTS

    def name(raw):
        return one(spark, raw, lambda c: territory.canonical(text.text_key(c), DEPARTMENTS, DEPARTMENT_ALIASES))

    assert [name(x) for x in ("Junín", "cuzco", "San Martín de Porres", "nowhere", None)] == ["JUNIN", "CUSCO", "LIMA", None, None]
    best = one(spark, "LAMBAYEQE", lambda c: territory.fuzzy(c, DEPARTMENTS))
    assert best["name"] == "LAMBAYEQUE" and best.score == pytest.approx(200 * 9 / 19)  # insertions and deletions, not edits
    for text_, found, score in (("LIMA PROVINCIA", "LIMA", 90.0), ("DEPARTAMENTO DE PIURA", "PIURA", 90.0), ("LIBERTAD LA", "LA LIBERTAD", 95.0), ("CUSCO", "CUSCO", 100.0)):
        best = one(spark, text_, lambda c: territory.fuzzy(c, DEPARTMENTS))
        assert (best["name"], round(best.score, 6)) == (found, score)
    assert one(spark, "", lambda c: territory.fuzzy(c, DEPARTMENTS)) is None
