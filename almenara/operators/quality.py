"""Data-quality rules. No rule deletes a row: each one flags, counts and states an action."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import pct, share, to_number, true
from almenara.functions.text import (
    canonical_category, canonical_state, clean_text, glued_words, has_mojibake, repair_mojibake, words,
)
from almenara.operators.ordered import null_safe_join
from almenara.settings import ACCESS, ACTIVE_STATES, RESOLUTIVE_CATEGORIES, TEXT, BoundingBox

KEPT, CORRECTED, CLEAN = "RETENIDO", "CORREGIDO", "SIN_HALLAZGOS"


# ---------------------------------------------------------------- coordinates
def in_box(lon: Column, lat: Column, box: BoundingBox = ACCESS.box) -> Column:
    """Inclusive on every side; an unknown coordinate is outside."""
    return true(lon.between(box.lon_min, box.lon_max) & lat.between(box.lat_min, box.lat_max))


def validate_coordinates(
    df: DataFrame, lat: str = "lat_raw", lon: str = "lon_raw",
    box: BoundingBox = ACCESS.box, swap: bool = True,
) -> DataFrame:
    """R1 missing or zero, R3 swapped, R2 outside the box; final ``lat, lon, coord_valid, coord_flags``.

    A swapped pair is corrected when ``swap`` is set, and only then counts as recovered.
    """
    y, x = F.col("_lat"), F.col("_lon")
    df = df.withColumns({"_lat": to_number(lat), "_lon": to_number(lon)})
    r1 = y.isNull() | x.isNull() | (y == 0) | (x == 0)
    r3 = ~in_box(x, y, box) & in_box(y, x, box) & ~r1
    df = df.withColumns({"r1": r1, "r3": r3})
    turn = F.col("r3") & F.lit(swap)
    df = df.withColumns({"lat": F.when(turn, x).otherwise(y), "lon": F.when(turn, y).otherwise(x)})
    inside = in_box(F.col("lon"), F.col("lat"), box)
    df = df.withColumns({"r2": ~inside & ~F.col("r1"), "coord_valid": inside & ~F.col("r1")})
    codes = F.array(*[F.when(F.col(c), c.upper()) for c in ("r1", "r3", "r2")])
    return df.withColumn("coord_flags", F.array_join(F.array_compact(codes), "|")).drop("_lat", "_lon")


# ---------------------------------------------------------------- repeated keys
def flag_repeats(df: DataFrame, key: str, ordinal: str, out: str = "is_repeat") -> DataFrame:
    """True on every row of a key but the first; only repeated keys take part in the join."""
    firsts = df.groupBy(key).agg(F.min(ordinal).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return (
        null_safe_join(df, firsts.drop("_n"), [key], "left")
        .withColumn(out, true(F.col(ordinal) > F.col("_first"))).drop("_first")
    )


def flag_copies(df: DataFrame, key: str, out: str) -> DataFrame:
    """True on every row of a key that occurs more than once."""
    copies = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    return null_safe_join(df, copies, [key], "left").withColumn(out, F.col("_n").isNotNull()).drop("_n")


# ---------------------------------------------------------------- encoding
def repair_text_columns(df: DataFrame, columns: list[str], repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """R6: repaired table and, per column, cells with a signature and cells changed by the repair."""
    present = [c for c in columns if c in df.columns]
    counts = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.count_if(has_mojibake(c)).alias("flagged"),
            F.count_if(true(has_mojibake(c) & (repair_mojibake(c) != F.col(c)))).alias("repaired"),
        ) for c in present
    ]).alias("r")).select(F.inline("r"))
    fixed = {
        c: clean_text(F.when(has_mojibake(c), repair_mojibake(c)).otherwise(F.col(c)) if repair else F.col(c))
        for c in present
    }
    return df.withColumns(fixed), counts


# ---------------------------------------------------------------- capacity
def add_capacity(df: DataFrame) -> DataFrame:
    """Canonical category and state, whether the facility can operate, whether it can be routed to."""
    df = df.withColumns({"category": canonical_category("category_raw"), "state": canonical_state("state_raw")})
    return df.withColumns({
        "resolutive": F.col("category").isin(*RESOLUTIVE_CATEGORIES) & F.col("state").isin(*ACTIVE_STATES),
        "routable": F.col("coord_valid") & ~F.col("is_repeat"),
    })


def build_supply(raw: DataFrame) -> DataFrame:
    """Registry rows with every flag; rules see the whole registry, any scope is cut afterwards."""
    return add_capacity(validate_coordinates(flag_repeats(raw, "facility_id", "ord")))


def in_scope(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    return df.filter(F.upper(F.col(column)).isin(*names))


# ---------------------------------------------------------------- rule report
@dataclass(frozen=True)
class Rule:
    """What a rule marks, and which of the marked rows it recovers or sets aside."""

    code: str
    description: str
    flagged: Column
    recovered: Column | None = None
    discarded: Column | None = None
    evaluated: Column | None = None
    reason: str = ""


def rule_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule from a single pass over the table."""
    def count(c: Column | None) -> Column:
        return F.lit(0).cast("long") if c is None else F.count_if(true(c))

    rows = [
        F.struct(
            F.lit(r.code).alias("rule"), F.lit(r.description).alias("description"),
            (F.count("*") if r.evaluated is None else count(r.evaluated)).alias("evaluated"),
            count(r.flagged).alias("flagged"), count(r.recovered).alias("recovered"),
            count(r.discarded).alias("discarded"), F.lit(r.reason).alias("reason"),
        ) for r in rules
    ]
    flat = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    kept = F.col("flagged") - F.col("recovered")
    return flat.withColumns({
        "pct_flagged": pct(F.col("flagged"), F.col("evaluated"), 3),
        "pct_recovered": pct(F.col("recovered"), F.col("flagged"), 1),
        "action": F.when(F.col("flagged") == 0, CLEAN)
        .when((F.col("recovered") > 0) & (kept == 0), CORRECTED).otherwise(KEPT),
    })


def supply_rules(swap: bool = True) -> list[Rule]:
    r1, r2, r3, rep = F.col("r1"), F.col("r2"), F.col("r3"), F.col("is_repeat")
    return [
        Rule("R5", "El mismo codigo se repite", rep, discarded=rep, reason="se conserva la primera aparicion"),
        Rule("R1", "Falta la posicion o vale cero", r1, discarded=r1, reason="sin posicion recuperable"),
        Rule("R3", "Los dos ejes estan cambiados", r3, recovered=r3 if swap else None, reason="solo admite una lectura"),
        Rule("R2", "La posicion cae fuera del recuadro", r2, discarded=r2, reason="sin lectura alternativa"),
    ]


# ---------------------------------------------------------------- accepted values
def check_domains(df: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """``reasons``: one text per column whose value is not allowed; empty for accepted rows."""
    reasons = [
        F.when(~true(F.col(c).isin(*values)),
               F.concat(F.lit(f"{c}: opcion no encontrada: "), F.coalesce(F.col(c).cast("string"), F.lit(""))))
        for c, values in allowed.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejects(checked: DataFrame, identifier: Column) -> DataFrame:
    return checked.filter(F.size("reasons") > 0).select(
        "*", identifier.alias("identifier"), F.array_join("reasons", "; ").alias("reason")
    ).drop("reasons")


def run_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("processed"), F.count_if(F.size("reasons") == 0).alias("loaded"),
        F.count_if(F.size("reasons") > 0).alias("skipped"),
    )


# ---------------------------------------------------------------- demand points
def classify_urban(points: DataFrame, threshold: float, categories: tuple[str, ...]) -> DataFrame:
    """Urban by weight or by category, and which of the two held."""
    by_weight = true(F.col("weight") >= threshold)
    by_category = true(F.upper("category").isin(*[c.upper() for c in categories]))
    return points.withColumns({
        "is_urban": by_weight | by_category,
        "urban_criterion": F.when(by_weight & by_category, "poblacion_y_categoria")
        .when(by_weight, f"poblacion>={threshold:.0f}").when(by_category, "categoria").otherwise("rural"),
    })


def minimum_weight(points: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """Points at or above ``minimum`` and what was lost, rows and weight apart."""
    low, w = true(F.col("weight") < minimum), F.col("weight")
    lost = F.sum(F.when(low, w).otherwise(0.0))
    report = points.agg(
        F.count("*").alias("rows_before"), F.count_if(low).alias("rows_lost"), lost.alias("weight_lost"),
        share(lost, F.sum(w), 4).alias("pct_weight_lost"),
    )
    return points.filter(~low), report


# ---------------------------------------------------------------- documents
def check_sources(pages: DataFrame) -> DataFrame:
    """Verdict per document: share of pages without text, and whether words look glued together.

    ``pages`` has ``doc, page, text``. The reading order is judged on all pages.
    """
    n = F.length("text")
    stats = pages.groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum(n).alias("chars"),
        F.count_if(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) < TEXT.low_text_chars).alias("low_pages"),
        (F.sum(n + 1) - 1).alias("_sample"),
        F.sum(F.size(words("text"))).alias("_words"),
        F.sum(glued_words("text")).alias("_glued"),
    )
    low = 100.0 * F.col("low_pages") / F.col("pages")
    ordered = (F.col("_sample") >= TEXT.min_sample_chars) & true(
        F.try_divide("_glued", "_words") < TEXT.glued_share
    )
    stats = stats.withColumns({"pct_low_pages": low, "order_ok": ordered})
    reasons = F.array_compact(F.array(
        F.when(F.col("pct_low_pages") > TEXT.max_low_text_pct, "paginas sin texto extraible"),
        F.when(~F.col("order_ok"), "orden de lectura incorrecto"),
    ))
    return stats.withColumns({
        "usable": F.size(reasons) == 0,
        "reason": F.when(F.size(reasons) == 0, "usable tal cual").otherwise(F.array_join(reasons, "; ")),
    }).drop("_sample", "_words", "_glued")


# ---------------------------------------------------------------- contracts
def expect(name: str, violations: DataFrame) -> DataFrame:
    """One result row: how many rows break the contract."""
    return violations.agg(F.count("*").alias("violations")).select(
        F.lit(name).alias("contract"), "violations", (F.col("violations") == 0).alias("ok")
    )


def expect_rows(df: DataFrame, contracts: dict[str, Column]) -> DataFrame:
    """Row predicates that must hold, all counted in a single pass."""
    rows = [
        F.struct(F.lit(n).alias("contract"), F.count_if(~true(c)).alias("violations")) for n, c in contracts.items()
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("ok", F.col("violations") == 0)


def expect_unique(name: str, df: DataFrame, *keys: str) -> DataFrame:
    return expect(name, df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"))


def expect_keys_in(name: str, df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return expect(name, df.join(other.select(key), key, "left_anti"))


def all_contracts(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def enforce(results: DataFrame) -> None:
    """Stop the job when a contract is broken; the message names all the broken ones (one row per contract)."""
    told = F.concat("contract", F.lit(": "), F.col("violations").cast("string"), F.lit(" violations"))
    broken = results.filter(~F.col("ok")).agg(F.array_join(F.array_sort(F.collect_list(told)), "; ").alias("all")).first()["all"]
    if broken:
        raise ValueError(broken)
