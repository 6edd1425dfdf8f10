"""Assigning a canonical department to rows that name their place in several messy ways."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import pct
from almenara.functions.text import text_key
from almenara.settings import DEPARTMENT_ALIASES, DEPARTMENTS, NOT_LOCATED, RISK

STEPS = (
    ("1_campo_departamento", "campo_departamento"), ("2_campo_region", "campo_region"),
    ("3_imputado_por_entidad", "imputado_por_entidad"), ("4_fuzzy_localidad", "fuzzy_localidad"),
    ("5_no_localizado", "no_localizado"),
)


def canonical(key: Column, canon: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """The name itself, else the name an alias stands for, else NULL. ``key`` is a text key."""
    out = F.when(key.isin(*canon), key)
    if aliases:
        pairs = [F.lit(x) for kv in aliases.items() for x in kv]
        out = F.coalesce(out, F.try_element_at(F.create_map(*pairs), key))
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by dynamic programming over the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(b)) - 1
    left = whole
    for c in a:
        hit = left & places.get(c, 0)
        left = (left + hit | left - hit) & whole
    return len(b) - left.bit_count()


def share(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, 0 to 100: insertions and deletions count 1 each."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def part_share(a: str, b: str) -> float:
    """The best share of the shorter text and any stretch of its length, or shorter at the ends, of the longer one;
    of two of one length either may be cut."""
    found = 0.0
    for short, long in ((a, b), (b, a)):
        if 0 < len(short) <= len(long):
            stretches = {long[max(0, end - len(short)) : end] for end in range(1, len(short) + len(long))}
            found = max(found, *(share(short, s) for s in stretches))
    return found


def word_set_share(a: str, b: str) -> float:
    """Likeness of the sets of words: 100 if one set holds the other, else the best share among the shared words, these
    with the rest of one text, and these with the rest of the other; the share of the sorted sets if none is shared."""
    one, two = set(a.split()), set(b.split())
    both = " ".join(sorted(one & two))
    if not both:
        return share(" ".join(sorted(one)), " ".join(sorted(two)))
    left, right = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if not left or not right:
        return 100.0
    n, m, k = len(left), len(right), len(both)
    apart = n + m - 2 * common_length(left, right)
    return max(100.0 * (1 - apart / (2 * k + n + m + 2)), 200.0 * k / (2 * k + n + 1), 200.0 * k / (2 * k + m + 1))


def match_score(a: str, b: str) -> float:
    """The best of several readings: whole, by sorted words, by sets of words, and, where one text is half as long again
    as the other, as a part of it. Readings by words weigh 0.95; a part weighs 0.9, or 0.6 where the longer text is
    over eight times as long; a shared word makes a part by words whole. The readings and weights are the study's."""
    ratio = max(len(a), len(b)) / max(1, min(len(a), len(b)))
    ordered = [" ".join(sorted(x.split())) for x in (a, b)]
    if ratio < 1.5:
        return max(share(a, b), 0.95 * share(*ordered), 0.95 * word_set_share(a, b))
    weight = 0.9 if ratio <= 8 else 0.6
    unique = [" ".join(sorted(set(x.split()))) for x in (a, b)]
    words = 100.0 if set(a.split()) & set(b.split()) else max(part_share(*ordered), part_share(*unique))
    return max(share(a, b), weight * part_share(a, b), 0.95 * weight * words)


def fuzzy(key: Column, canon: tuple[str, ...]) -> Column:
    """Closest canonical name and its :func:`match_score`; the first of the list wins a tie. NULL for no text.

    Meant for distinct values against a short fixed list. Spark has no common subsequence, and nested column lambdas
    for 25 names took minutes to plan, so Arrow batches of values are scored in Python.
    """
    @F.pandas_udf("score double, name string")
    def closest(keys: pd.Series) -> pd.DataFrame:
        rows = [max(((match_score(k, c), -i, c) for i, c in enumerate(canon)), default=(None, 0, None)) if k else (None, 0, None) for k in keys]
        return pd.DataFrame([(score, name) for score, _, name in rows], columns=["score", "name"])

    return F.when(key != "", closest(key))


#: Into how many parts rows without a join key are dealt.
DEALT = 1 << 16


def _join_open(rows: DataFrame, found: DataFrame, is_open: Column, key: Column) -> DataFrame:
    """Left join of ``rows`` on ``found._on`` for those that are open; the others need no partner and crowd no task."""
    spread = F.when(is_open, 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(DEALT)).cast("int") + 1)
    left = rows.withColumns({"_own": F.when(is_open, key), "_deal": spread})
    # Always 0, but no literal: Spark would make that a filter, join on the key alone and bring all rows without one together.
    right = found.withColumn("_part", F.pmod(F.xxhash64("_on"), F.lit(1)).cast("int"))
    return left.join(right, (F.col("_own") == F.col("_on")) & (F.col("_deal") == F.col("_part")), "left").drop("_own", "_deal", "_on", "_part")


def resolve_departments(
    df: DataFrame, canon: tuple[str, ...] = DEPARTMENTS, aliases: dict[str, str] = DEPARTMENT_ALIASES,
    threshold: float = RISK.fuzzy_threshold, key=text_key, entity: str = "entity_id",
) -> DataFrame:
    """Cascade: department field, region field, the entity's usual department, fuzzy locality.

    Adds ``department, department_origin, department_score``; rows nothing resolves stay, labelled. Only rows still
    open carry a key into the two joins; all others have none and are dealt by a hash of the row.
    """
    direct = df.withColumns({
        "_d1": canonical(key("department_raw"), canon, aliases),
        "_d2": canonical(key("region_raw"), canon, aliases),
    }).withColumn("_known", F.coalesce("_d1", "_d2"))

    usual = usual_value(direct.filter(F.col(entity).isNotNull()), entity, "_known").withColumnsRenamed({"_known": "_d3", entity: "_on"})
    with_usual = _join_open(direct, usual, F.col("_known").isNull() & F.col(entity).isNotNull(), F.col(entity)).withColumn("_key", key("locality_raw"))
    pending = F.col("_known").isNull() & F.col("_d3").isNull()
    words = with_usual.filter(pending & (F.col("_key") != "")).select(F.col("_key").alias("_on")).distinct().withColumn(
        "_f", fuzzy(F.col("_on"), canon)
    )
    hit = F.when(pending & (F.col("_f.score") >= threshold), F.col("_f.name"))
    out = _join_open(with_usual, words, pending & (F.col("_key") != ""), F.col("_key"))
    return out.withColumns({
        "department": F.coalesce("_d1", "_d2", "_d3", hit, F.lit(NOT_LOCATED)),
        "department_origin": F.when(F.col("_d1").isNotNull(), STEPS[0][1]).when(F.col("_d2").isNotNull(), STEPS[1][1])
        .when(F.col("_d3").isNotNull(), STEPS[2][1]).when(hit.isNotNull(), STEPS[3][1]).otherwise(STEPS[4][1]),
        "department_score": F.when(F.col("_known").isNotNull(), 100.0).when(F.col("_d3").isNotNull(), 90.0)
        .when(hit.isNotNull(), F.col("_f.score")).otherwise(0.0),
    }).drop("_d1", "_d2", "_d3", "_known", "_key", "_f")


def usual_value(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Most frequent value per entity; equal counts go to the smaller value."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(entity, value).agg(F.count("*").alias("_n"))
    return votes.groupBy(entity).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def recovery_report(resolved: DataFrame) -> DataFrame:
    """Rows each step resolved, and all located rows."""
    n = F.count("*")
    rows = [
        F.struct(F.lit(step).alias("step"), F.count_if(F.col("department_origin") == origin).alias("rows"),
                 pct(F.count_if(F.col("department_origin") == origin), n).alias("pct"))
        for step, origin in STEPS
    ]
    located = F.count_if(F.col("department_origin") != STEPS[-1][1])
    rows.append(F.struct(F.lit("TOTAL_LOCALIZADOS").alias("step"), located.alias("rows"), pct(located, n).alias("pct")))
    return resolved.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def attach_by_name(shapes: DataFrame, name_fields: list[str], values: DataFrame, name: str, defaults: dict) -> DataFrame:
    """Map shapes with their value by normalised name, taken from the first non-empty field."""
    own = F.coalesce(*[F.nullif(text_key(f), F.lit("")) for f in name_fields])
    keyed = values.withColumn("_k", text_key(name)).drop(name)
    return shapes.withColumn("_k", own).join(keyed, "_k", "left").drop("_k").fillna(defaults)
