"""Order statistics against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almenara.operators import inequality
from almenara.operators.ordered import quantiles, quantiles_of, running_sums, top_n, weighted_quantiles, with_levels


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # One group holds most rows, one value repeats in a third of them, magnitudes differ widely.
    group = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.5, "b", "c"))
    value = np.where(rng.random(n) < 0.33, 12.5, np.exp(rng.normal(2, 3, n)))
    value[:40] = -value[:40]
    weight = np.round(rng.random(n) * 50, 2)
    weight[::17] = 0.0
    data = [(int(i), str(g), float(v), float(w)) for i, (g, v, w) in enumerate(zip(group, value, weight))]
    df = spark.createDataFrame(data, "id long, g string, v double, w double").repartition(4)
    return df.cache(), group, value, weight


def expected_weighted(v, w, q):
    keep = w > 0
    order = np.lexsort((w[keep], v[keep]))
    v, w = v[keep][order], w[keep][order]
    return float(np.interp(q * w.sum(), np.cumsum(w) - w / 2, v))


def test_running_sums_equal_numpy(sample):
    df, group, value, weight = sample
    out = running_sums(df, ["g"], "v", {"w": F.col("w"), "n": F.lit(1)}).collect()
    for g in ("hot", "b", "c"):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.v)
        distinct = np.unique(value[group == g])
        assert [r.v for r in mine] == pytest.approx(list(distinct))
        sums = np.array([weight[(group == g) & (value == v)].sum() for v in distinct])
        assert [r.before_w for r in mine] == pytest.approx(list(np.cumsum(sums) - sums), abs=1e-6)
        assert {r.total_n for r in mine} == {int((group == g).sum())}


def test_weighted_quantiles_equal_numpy(sample):
    df, group, value, weight = sample
    out = {r.g: r for r in weighted_quantiles(df, ["g"], "v", "w", {"p1": 0.01, "p50": 0.5, "p90": 0.9}).collect()}
    for g in ("hot", "b", "c"):
        m = group == g
        for name, q in (("p1", 0.01), ("p50", 0.5), ("p90", 0.9)):
            assert out[g][name] == pytest.approx(expected_weighted(value[m], weight[m], q), rel=1e-9)


def test_weighted_quantile_is_clamped_at_the_ends(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0), (2, 20.0, 4.0)], "id int, v double, w double")
    r = weighted_quantiles(df, [], "v", "w", {"lo": 0.0, "hi": 1.0, "mid": 0.5}).first()
    assert (r.lo, r.hi, r.mid) == (10.0, 20.0, 15.0)


def test_quantiles_equal_numpy_in_total_and_per_group(sample):
    df, group, value, _ = sample
    total = quantiles(df, [], "v", {"a": 0.25, "b": 0.95}).first()
    assert (total.a, total.b) == pytest.approx((np.quantile(value, 0.25), np.quantile(value, 0.95)))
    for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect():
        assert r.m == pytest.approx(np.median(value[group == r.g]))


def test_quantiles_of_several_measures(sample):
    df, group, value, weight = sample
    out = quantiles_of(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, {"mv": ("v", 0.5), "pw": ("w", 0.9)})
    for r in out.collect():
        assert r.mv == pytest.approx(np.median(value[group == r.g]))
        assert r.pw == pytest.approx(np.quantile(weight[group == r.g], 0.9))


def test_null_group_and_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, v double")
    assert {r.g: r.m for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 5.0}


def test_gini_and_lorenz_equal_numpy(sample):
    df, group, value, weight = sample
    out = {r.g: r.gini for r in inequality.gini(df, ["g"], "v", "w").collect()}
    curve = inequality.lorenz_curve(df, ["g"], "v", "w").collect()
    for g in ("hot", "b", "c"):
        m = (group == g) & (weight > 0) & (value >= 0)
        order = np.argsort(value[m])
        w, wv = weight[m][order], (weight * value)[m][order]
        x, y = np.insert(np.cumsum(w) / w.sum(), 0, 0), np.insert(np.cumsum(wv) / wv.sum(), 0, 0)
        assert out[g] == pytest.approx(1 - np.sum(np.diff(x) * (y[1:] + y[:-1])))
        mine = sorted((r for r in curve if r.g == g), key=lambda r: r.pct_weight)
        assert len(mine) == 101
        assert [r.pct_value for r in mine] == pytest.approx(list(100 * np.interp(np.linspace(0, 1, 101), x, y)), abs=1e-6)


def test_gini_needs_two_rows_and_a_total(spark):
    df = spark.createDataFrame([("one", 3.0, 1.0), ("zero", 0.0, 1.0), ("zero", 0.0, 2.0)], "g string, v double, w double")
    assert {r.g: r.gini for r in inequality.gini(df, ["g"], "v", "w").collect()} == {"one": None, "zero": None}


def test_top_n_keeps_the_group_order(sample):
    df, group, value, _ = sample
    out = top_n(df, ["g"], [F.desc("v"), F.asc("id")], 5, salts=4).collect()
    for g in ("hot", "b", "c"):
        best = sorted(((-v, i) for i, (v, k) in enumerate(zip(value, group)) if k == g))[:5]
        assert [r.id for r in sorted((r for r in out if r.g == g), key=lambda r: r["rank"])] == [i for _, i in best]


def test_levels_repeat_rows_with_rolled_up_keys(spark):
    df = spark.createDataFrame([("r", "d", 1)], "region string, district string, x int")
    out = with_levels(df, {"district": ["region", "district"], "region": ["region"], "TOTAL": []})
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        map(str, [("district", "r", "d", 1), ("region", "r", None, 1), ("TOTAL", None, None, 1)])
    )


@pytest.mark.parametrize("n", [4, 10, 57])
def test_spearman_uses_average_ranks(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 5, n).astype(float), rng.integers(0, 7, n).astype(float)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, a) + np.searchsorted(order, a, side="right") + 1) / 2 for a in v])

    r = inequality.correlations(df, ["g"], "x", "y").first()
    assert r.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert r.spearman_rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_correlations_with_half_the_rows_tied(spark):
    """One value of x and one of y stand in half of the rows; both are looked up in the list of hot values."""
    rng = np.random.default_rng(5)
    n = 6000
    x, y = np.round(rng.normal(50, 20, n), 3), np.round(rng.normal(30, 9, n), 3)
    y = np.round(y + 0.2 * x, 3)
    x[: n // 2], y[n // 4: 3 * n // 4] = 7.0, 11.0
    g = np.where(np.arange(n) % 3 > 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    out = {r.g: r for r in inequality.correlations(df, ["g"], "x", "y").collect()}
    for k in "ab":
        a, b = pd.Series(x[g == k]), pd.Series(y[g == k])
        assert out[k].rows == len(a) and out[k].mean_x == pytest.approx(a.mean())
        assert out[k].pearson_r == pytest.approx(a.corr(b)) and out[k].spearman_rho == pytest.approx(a.rank().corr(b.rank()))
    flat = inequality.correlations(df.withColumn("x", F.lit(1.0)), ["g"], "x", "y").collect()
    assert [(r.pearson_r, r.spearman_rho) for r in flat] == [(None, None)] * 2


def test_quantiles_add_sums_of_rows_without_a_value(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 20), ("a", None, 30), ("b", None, 5)], "g string, v int, w int")
    out = {r.g: r for r in quantiles(df, ["g"], "v", {"m": 0.5}, {"n": F.lit(1), "w": F.col("w")}).collect()}
    assert (out["a"].m, out["a"].n, out["a"].w) == (2.0, 3, 60) and (out["b"].m, out["b"].n, out["b"].w) == (None, 1, 5)
    assert quantiles(df.filter("w > 99"), [], "v", {"m": 0.5}, {"n": F.lit(1)}).collect() == [(None, None)]


def test_running_sums_keep_values_without_an_extra(spark):
    from pyspark.sql import functions as F

    from almenara.operators.ordered import running_sums

    df = spark.createDataFrame([("a", 1.0, None), ("a", 500.0, 2.0)], "g string, v double, x double")
    rows = running_sums(df, ["g"], "v", {"n": F.lit(1)}, {"top": F.max("x")}).orderBy("v").collect()
    assert [(r["v"], r["before_n"], r["total_n"], r["top"]) for r in rows] == [(1.0, 0, 2, None), (500.0, 1, 2, 2.0)]
