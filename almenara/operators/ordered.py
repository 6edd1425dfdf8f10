"""Exact order statistics and running sums without sorting a group in one task.

Values are first collapsed to one row per (group, value), which combines on the map side, and
then cut into narrow value ranges. A running sum is the running sum inside a range (a window over
one range) plus the total of the ranges below it (a window over one row per range). A group that
holds a third of all rows is therefore spread over thousands of ranges, and the range of a row
depends on its value alone, so a recomputed partition lands in the same place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES_PER_UNIT = 1024


def value_range(value: Column, per_unit: int = RANGES_PER_UNIT) -> Column:
    """Number of the range holding ``value``: linear near zero, logarithmic away from it."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(per_unit)).cast("long")


def with_levels(df: DataFrame, levels: dict[str, list[str]], label: str = "level") -> DataFrame:
    """Each row once per aggregation level; keys outside a level become NULL."""
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    variants = [
        F.struct(
            F.lit(name).alias(label),
            *[(F.col(k) if k in cols else F.lit(None).cast(df.schema[k].dataType)).alias(k)
              for k in keys],
        )
        for name, cols in levels.items()
    ]
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.select(*rest, F.explode(F.array(*variants)).alias("_lv")).select(
        "_lv.*", *[c for c in df.columns if c not in keys]
    )


def sums_by_level(
    df: DataFrame, levels: dict[str, list[str]], sums: dict[str, Column], label: str = "level"
) -> DataFrame:
    """Sums (and counts) at every level: the rows are summed once per finest key, and only those
    sums are repeated for the coarser levels."""
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    finest = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    return with_levels(finest, levels, label).groupBy(label, *keys).agg(*[F.sum(n).alias(n) for n in sums])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    by: list[str],
    value: str,
    sums: dict[str, Column],
    extras: dict[str, Column] | None = None,
    per_unit: int = RANGES_PER_UNIT,
) -> DataFrame:
    """One row per (group, value): each sum, ``before_<sum>`` and ``total_<sum>``.

    ``extras`` are further aggregates per (group, value) that are carried along.
    """
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    collapsed = src.groupBy(*keys, value).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[e.alias(n) for n, e in (extras or {}).items()],
    ).withColumn("_range", value_range(F.col(value), per_unit))

    # Both branches read every column of the collapsed rows, so they share one shuffle of them.
    read = [F.count(n) for n in extras or {}]
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per_range = collapsed.groupBy(*keys, "_range").agg(
        *[F.sum(n).alias(n) for n in sums], *[c.alias(f"_has_{i}") for i, c in enumerate(read)]
    )
    for i in range(len(read)):
        per_range = per_range.filter(F.col(f"_has_{i}") >= 0)  # always so
    ranges = per_range.select(
        *keys, "_range",
        *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"total_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = collapsed.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums]
    )
    joined = null_safe_join(local, ranges, [*keys, "_range"])
    out = joined.withColumns({f"before_{n}": F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in sums})
    return out.drop("_range", "_all", *[f"_in_{n}" for n in sums], *[f"_off_{n}" for n in sums])


def _interpolate(name: str, at: Column) -> Column:
    """Linear interpolation between the neighbours of the wanted position; ends are clamped."""
    lc, lv, hc, hv = (F.col(f"_{k}_{name}") for k in ("lc", "lv", "hc", "hv"))
    return (
        F.when(lc.isNull(), hv).when(hc.isNull() | (hc == lc), lv)
        .otherwise(lv + (at - lc) * (hv - lv) / (hc - lc))
    )


def quantiles(
    df: DataFrame, by: list[str], value: str, qs: dict[str, float], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks, NULLs ignored.

    ``sums`` are added up per group from the same collapsed rows, so ``df`` is computed once; they count rows
    without a value as well, and a group of such rows alone has NULL quantiles.
    """
    sums = sums or {}
    known = F.col(value).isNotNull()
    rows = running_sums(
        (df if sums else df.filter(known)).select(
            *by, F.col(value).cast("double").alias(value), *[c.alias(f"_s_{n}") for n, c in sums.items()]
        ),
        by, value, {"n": known.cast("int"), **{f"_s_{n}": F.col(f"_s_{n}") for n in sums}},
    )
    aggs, outs = [F.sum(f"_s_{n}").alias(n) for n in sums], [F.col(n) for n in sums]
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("total_n") - 1)
        reach = F.col("before_n") + F.col("n") - 1
        aggs += [
            F.min(F.when(reach >= F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(reach >= F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    return rows.groupBy(*by).agg(*aggs).select(*by, *outs)


def quantiles_of(
    df: DataFrame, by: list[str], measures: dict[str, Column], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Quantiles of several measures in one pass: ``wanted`` maps a name to (measure, q)."""
    rows = df.select(*by, F.explode(F.filter(F.array(*[
        F.struct(F.lit(m).alias("_m"), c.cast("double").alias("_v")) for m, c in measures.items()
    ]), lambda x: x["_v"].isNotNull())).alias("_x")).select(*by, "_x.*")
    qs = sorted({q for _, q in wanted.values()})
    found = quantiles(rows, [*by, "_m"], "_v", {f"_q{i}": q for i, q in enumerate(qs)})
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("_m") == m, F.col(f"_q{qs.index(q)}"))).alias(name) for name, (m, q) in wanted.items()
    ])


def weighted_quantiles(
    df: DataFrame, by: list[str], value: str, weight: str, qs: dict[str, float]
) -> DataFrame:
    """Quantiles of a weighted distribution, each row sitting at the middle of its own weight.

    Rows with equal values are ordered by weight; only the first and the last of them can be a
    neighbour of the wanted position, so the tie block is kept as its smallest and largest weight.
    """
    w = F.col(weight).cast("double")
    valid = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).select(
        *by, F.col(value).cast("double").alias("_v"), w.alias("_w"), w.alias("_first"), w.alias("_last"),
    )
    return collapsed_weighted_quantiles(valid, by, "_v", "_w", "_first", "_last", qs)


def collapsed_weighted_quantiles(
    df: DataFrame, by: list[str], value: str, weight: str, first: str, last: str, qs: dict[str, float],
    also: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`weighted_quantiles` of rows that stand for several of equal value: their summed,
    smallest and largest weight. ``also`` names columns to read although nothing comes of them."""
    rows = running_sums(
        df.withColumn("_v", F.col(value)), by, "_v", {"w": F.col(weight), **{f"x{c}": F.col(c) for c in also}},
        {"w_first": F.min(first), "w_last": F.max(last)},
    )
    v = F.col("_v")
    c_first = F.col("before_w") + F.col("w_first") / 2
    c_last = F.col("before_w") + F.col("w") - F.col("w_last") / 2

    aggs, outs = [], []
    for name, q in qs.items():
        at = F.lit(float(q)) * F.col("total_w")
        below = F.when(c_last <= at, c_last).when(c_first <= at, c_first)
        above = F.when(c_first >= at, c_first).when(c_last >= at, c_last)
        aggs += [
            F.max(below).alias(f"_lc_{name}"), F.max_by(v, below).alias(f"_lv_{name}"),
            F.min(above).alias(f"_hc_{name}"), F.min_by(v, above).alias(f"_hv_{name}"),
            F.max(at).alias(f"_at_{name}"),
        ]
        outs.append(_interpolate(name, F.col(f"_at_{name}")).alias(name))
    return rows.groupBy(*by).agg(*aggs).select(*by, *outs)


def top_n(
    df: DataFrame, by: list[str], order: list[Column], n: int, salts: int = 32,
    spread: list[str] | None = None, rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows of each group in ``order``, with their rank.

    Each group is cut into ``salts`` slices that keep their own first ``n`` before the group is
    brought together, so no task ever sorts more than a slice or ``salts * n`` rows.
    """
    salted = df.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in (spread or df.columns)]), F.lit(salts))
    )
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)
    )
