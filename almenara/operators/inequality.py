"""Weighted inequality of a value and its relation to a second dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import p_value, rounded, to_number
from almenara.operators.access import TOTAL, group_sums, valid_time
from almenara.operators.ordered import null_safe_join, quantiles_of, running_sums, with_levels
from almenara.session import pin

QUADRANTS = (
    "doble carga: lejos y pobre", "lejos pero menos pobre", "cerca pero pobre", "cerca y menos pobre",
)
NO_DATA = "sin dato"


def _usable(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.filter((F.col(value) >= 0) & (F.col(weight) > 0))


def _lorenz_rows(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    w = F.col(weight).cast("double")
    v = F.col(value).cast("double")
    return running_sums(
        _usable(df, value, weight), by, value, {"w": w, "wv": w * v, "n": F.lit(1)}
    )


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean over rows with a value and positive weight; groups without such rows give NULL."""
    used = F.col(value).isNotNull() & (F.col(weight) > 0)
    return df.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.when(used, F.col(value) * F.col(weight))), F.sum(F.when(used, F.col(weight)))
        ).alias("mean")
    )


def gini(df: DataFrame, by: list[str], value: str = "t_min", weight: str = "weight") -> DataFrame:
    """Weighted Gini coefficient per group; NULL below two rows or without any total.

    Area under the Lorenz curve, segment by segment: a segment of weight ``w`` whose rows have
    value ``v`` adds ``w * (2 * total below + w * v)``, so every range of values adds its own part.
    """
    rows = _lorenz_rows(df, by, value, weight)
    area = F.sum(F.col("w") * (2 * F.col("before_wv") + F.col("wv")))
    g = rows.groupBy(*by).agg(
        area.alias("_a"), F.max("total_w").alias("_w"), F.max("total_wv").alias("_s"), F.sum("n").alias("_n")
    )
    ok = (F.col("_n") >= 2) & (F.col("_s") > 0)
    return g.select(*by, F.when(ok, 1 - F.col("_a") / (F.col("_w") * F.col("_s"))).alias("gini"))


def lorenz_curve(
    df: DataFrame, by: list[str], value: str = "t_min", weight: str = "weight", points: int = 101
) -> DataFrame:
    """Cumulative share of the value at evenly spaced shares of the weight.

    A segment of the curve only emits the grid points it covers.
    """
    last = points - 1
    rows = _lorenz_rows(df, by, value, weight).filter(F.col("total_wv") > 0)
    seg = rows.select(
        *by,
        (F.col("before_w") / F.col("total_w")).alias("x0"),
        ((F.col("before_w") + F.col("w")) / F.col("total_w")).alias("x1"),
        (F.col("before_wv") / F.col("total_wv")).alias("y0"),
        ((F.col("before_wv") + F.col("wv")) / F.col("total_wv")).alias("y1"),
    )
    slack = 1e-9
    first_k = F.greatest(F.ceil((F.col("x0") - slack) * last), F.lit(0))
    last_k = F.least(F.floor((F.col("x1") + slack) * last), F.lit(last))
    hits = seg.filter(first_k <= last_k).withColumn("k", F.explode(F.sequence(first_k, last_k)))
    x = F.col("k") / F.lit(last)
    best = F.max_by(F.struct("x0", "x1", "y0", "y1"), F.when(F.col("x0") <= x + slack, F.col("x0")))
    s = F.col("s")
    inside = F.least(F.greatest((F.col("k") / F.lit(last) - s["x0"]) / (s["x1"] - s["x0"]), F.lit(0.0)), F.lit(1.0))
    return hits.groupBy(*by, "k").agg(best.alias("s")).select(
        *by, (F.col("k") * (100.0 / last)).alias("pct_weight"),
        (100 * (s["y0"] + inside * (s["y1"] - s["y0"]))).alias("pct_value"),
    )


def _scopes(df: DataFrame, key: str) -> DataFrame:
    rows = with_levels(df, {"group": [key], TOTAL: []})
    return rows.filter((F.col("level") == TOTAL) | F.col(key).isNotNull()).withColumn(
        "scope", F.when(F.col("level") == TOTAL, TOTAL).otherwise(F.col(key).cast("string"))
    )


def inequality(access: DataFrame, key: str = "region") -> DataFrame:
    """Points, weight, Gini of travel time and mean time per group and in total."""
    ok, w = valid_time(), F.col("weight")
    used = ok & (w > 0)
    sums = group_sums(access, key, {
        "points": F.count_if(ok), "_w": F.sum(F.when(ok, w).otherwise(0.0)),
        "_vu": F.sum(F.when(used, F.col("t_min") * w)), "_u": F.sum(F.when(used, w)),
    }).withColumnRenamed("group_name", "scope")
    g = gini(_scopes(access.filter(ok), key), ["scope"])
    return sums.join(g, "scope", "left").select(
        "scope", "points", rounded(F.col("_w"), 0).alias("weight"),
        rounded(F.try_divide("_vu", "_u"), 1).alias("t_mean"), rounded(F.col("gini"), 4).alias("gini"),
    )


def lorenz_by_scope(access: DataFrame, key: str = "region") -> DataFrame:
    return lorenz_curve(_scopes(access.filter(valid_time()), key), ["scope"])


def load_poverty(raw: DataFrame, key: str = "district_int", rate: str = "rate_raw") -> DataFrame:
    """Key padded to six digits and a numeric rate; rows without a rate are left out."""
    return raw.select(
        F.lpad(F.col(key).cast("string"), 6, "0").alias("ubigeo"), to_number(rate).alias("poverty_rate")
    ).dropna()


#: A value with more pairs than this part of them all meets its rank by broadcast; there are at most twice as many.
HOT_PART = 1000


def _ranked_cells(cells: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, x, y, n, _total, _rx, _ry`` of pairs counted as ``n``: mean ranks of both values and the pairs of the group.

    Both values of a pair are listed below each other, so one ranking and one join serve the two. Values that many
    pairs share are looked up in a broadcast list of at most ``2 * HOT_PART`` rows and crowd no task.
    """
    key = [*by, "_side", "_v"]
    sides = cells.select(*by, x, y, "n", F.inline(F.array(
        F.struct(F.lit(0).alias("_side"), F.col(x).alias("_v")), F.struct(F.lit(1).alias("_side"), F.col(y).alias("_v"))
    )))
    ranks = pin(running_sums(sides, [*by, "_side"], "_v", {"n": F.col("n"), "c": F.lit(1)}).select(
        *key, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("_r"), F.col("total_n").alias("_t"), "c"
    ))
    hot = F.col("c") * HOT_PART > ranks.select(F.sum("c").alias("c")).scalar()
    listed = ranks.filter(hot).select(*key, F.col("_r").alias("_hr"), F.col("_t").alias("_ht"))
    marked = null_safe_join(sides, F.broadcast(listed), key, "left")
    met = null_safe_join(marked.filter(F.col("_hr").isNull()), ranks.filter(~hot).drop("c"), key).select(*by, x, y, "n", "_side", "_r", "_t")
    found = marked.filter(F.col("_hr").isNotNull()).select(*by, x, y, "n", "_side", F.col("_hr").alias("_r"), F.col("_ht").alias("_t"))
    return met.unionByName(found).groupBy(*by, x, y).agg(
        F.max("n").alias("n"), F.max("_t").alias("_total"),
        F.max(F.when(F.col("_side") == 0, F.col("_r"))).alias("_rx"), F.max(F.when(F.col("_side") == 1, F.col("_r"))).alias("_ry"),
    )


def correlations(
    pairs: DataFrame, by: list[str], x: str, y: str, min_rows: int = 4
) -> DataFrame:
    """Pearson and Spearman with two-sided p-values; groups below ``min_rows`` are left out.

    Rows are collapsed to distinct pairs of values with counts before anything is ranked or joined.
    """
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = pin(both.groupBy(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).agg(F.count("*").alias("n")))
    n = F.col("n")
    means = cells.groupBy(*by).agg(F.sum("n").alias("rows"), *[(F.sum(F.col(c) * n) / F.sum("n")).alias(f"_m{c}") for c in (x, y)]).filter(F.col("rows") >= min_rows)
    moved = null_safe_join(_ranked_cells(cells, by, x, y), means, by)
    middle = (F.col("_total") + 1) / 2.0

    def moments(a: Column, b: Column, name: str) -> list[Column]:
        return [F.sum(n * a * a).alias(f"{name}aa"), F.sum(n * b * b).alias(f"{name}bb"), F.sum(n * a * b).alias(f"{name}ab")]

    def r(name: str) -> Column:
        return F.try_divide(F.col(f"{name}ab"), F.sqrt(F.col(f"{name}aa")) * F.sqrt(F.col(f"{name}bb")))

    return (
        moved.groupBy(*by).agg(
            F.max("rows").alias("rows"), F.max(f"_m{x}").alias(f"mean_{x}"),
            *moments(F.col(x) - F.col(f"_m{x}"), F.col(y) - F.col(f"_m{y}"), "_p"),
            *moments(F.col("_rx") - middle, F.col("_ry") - middle, "_s"),
        )
        .select(*by, "rows", r("_p").alias("pearson_r"), r("_s").alias("spearman_rho"), f"mean_{x}")
        .withColumns({
            "pearson_p": p_value(F.col("pearson_r"), F.col("rows").cast("double")),
            "spearman_p": p_value(F.col("spearman_rho"), F.col("rows").cast("double")),
        })
    )


def join_poverty(units: DataFrame, poverty: DataFrame) -> DataFrame:
    """Units with their poverty rate and the quadrant both medians put them in."""
    joined = units.join(poverty, "ubigeo", "left")
    both = joined.filter(F.col("poverty_rate").isNotNull() & F.col("t_mean").isNotNull())
    middle = quantiles_of(
        both, [], {"t": F.col("t_mean"), "p": F.col("poverty_rate")}, {"t": ("t", 0.5), "p": ("p", 0.5)}
    ).select(F.struct("t", "p").alias("m")).scalar()
    mid_t, mid_p = middle["t"], middle["p"]
    far, near = F.col("t_mean") > mid_t, F.col("t_mean") <= mid_t
    poor, less = F.col("poverty_rate") > mid_p, F.col("poverty_rate") <= mid_p
    return joined.withColumn(
        "quadrant",
        F.when(far & poor, QUADRANTS[0]).when(far & less, QUADRANTS[1])
        .when(near & poor, QUADRANTS[2]).when(near & less, QUADRANTS[3]).otherwise(NO_DATA),
    )


def left_out_of_join(joined: DataFrame) -> DataFrame:
    """Units outside the comparison, by reason."""
    no_rate, no_time = F.col("poverty_rate").isNull(), F.col("t_mean").isNull()
    return joined.agg(
        F.count_if(no_rate & ~no_time).alias("without_rate"), F.count_if(no_time & ~no_rate).alias("without_time"),
        F.count_if(no_rate & no_time).alias("without_both"), F.count("*").alias("units"),
    )


def poverty_correlations(joined: DataFrame, key: str = "region") -> DataFrame:
    """Correlation of poverty and time per group and in total, at reporting precision."""
    out = correlations(_scopes(joined, key), ["scope"], "poverty_rate", "t_mean")
    return out.select(
        "scope", F.col("rows").alias("units"), rounded(F.col("pearson_r"), 3).alias("pearson_r"),
        rounded(F.col("pearson_p"), 4).alias("pearson_p"), rounded(F.col("spearman_rho"), 3).alias("spearman_rho"),
        rounded(F.col("spearman_p"), 4).alias("spearman_p"), rounded(F.col("mean_poverty_rate"), 1).alias("poverty_mean"),
    )


def largest_in_quadrant(joined: DataFrame, quadrant: str = QUADRANTS[0], n: int = 6) -> DataFrame:
    return joined.filter(F.col("quadrant") == quadrant).orderBy(F.desc("weight"), "ubigeo").limit(n)
