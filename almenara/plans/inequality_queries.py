"""Queries on inequality of access and its relation to poverty."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.operators import access as acc
from almenara.operators import inequality as ops
from almenara.plans.access_queries import _DISTRICTS, _units
from almenara.plans.oracle_text import VALID, rnd, weighted_quantile
from almenara.plans.registry import query
from almenara.session import pin

_SCOPES = """sc AS (SELECT CAST(region AS VARCHAR) AS scope, * FROM access UNION ALL SELECT 'TOTAL', * FROM access)"""
_LORENZ = f"""{_SCOPES},
lo AS (SELECT scope, weight AS w, weight * t_min AS wv, t_min,
  sum(weight) OVER (PARTITION BY scope ORDER BY t_min, point_id ROWS UNBOUNDED PRECEDING) AS cw,
  sum(weight * t_min) OVER (PARTITION BY scope ORDER BY t_min, point_id ROWS UNBOUNDED PRECEDING) AS cwv,
  sum(weight) OVER (PARTITION BY scope) AS tw, sum(weight * t_min) OVER (PARTITION BY scope) AS twv
  FROM sc WHERE {VALID} AND weight > 0 AND t_min >= 0)"""


@query("inequality", ("access",), f""", {_LORENZ},
gi AS (SELECT scope, 1 - sum(w / tw * (2 * cwv - wv) / twv) AS g FROM lo GROUP BY scope),
su AS (SELECT scope, count(*) FILTER (WHERE {VALID}) AS points, {rnd(f'coalesce(sum(weight) FILTER (WHERE {VALID}), 0)', 0)} AS weight,
  {rnd(f'sum(t_min * weight) FILTER (WHERE {VALID} AND weight > 0) / sum(weight) FILTER (WHERE {VALID} AND weight > 0)', 1)} AS t_mean
  FROM sc GROUP BY scope)
SELECT su.*, {rnd('g', 4)} AS gini FROM su LEFT JOIN gi ON su.scope = gi.scope""")
def _inequality(t):
    return ops.inequality(t.access)


@query("lorenz_curve", ("access",), f""", {_LORENZ},
seg AS (SELECT scope, (cw - w) / tw AS x0, cw / tw AS x1, (cwv - wv) / twv AS y0, cwv / twv AS y1 FROM lo),
g AS (SELECT scope, k, arg_max({{'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}, x0) AS s
  FROM seg, range(101) r(k) WHERE x0 <= k / 100.0 + 1e-9 GROUP BY scope, k)
SELECT scope, k * 1.0::DOUBLE AS pct_weight,
  round(100 * (s.y0 + least(greatest((k / 100.0 - s.x0) / (s.x1 - s.x0), 0), 1) * (s.y1 - s.y0)), 6) AS pct_value FROM g""")
def _lorenz(t):
    return ops.lorenz_by_scope(t.access).withColumn("pct_value", F.round("pct_value", 6))


@query("weighted_mean_time", ("access",), """SELECT district, round(sum(t_min * weight) FILTER (WHERE t_min IS NOT NULL AND weight > 0)
/ sum(weight) FILTER (WHERE t_min IS NOT NULL AND weight > 0), 6) AS mean FROM access GROUP BY district""")
def _mean(t):
    return ops.weighted_mean(t.access, ["district"], "t_min", "weight").withColumn("mean", F.round("mean", 6))


@query("weighted_percentiles", ("access",), f""", v AS (SELECT * FROM access WHERE {VALID}),
a AS ({weighted_quantile('v', ['district'], 0.1, 'p10')}), b AS ({weighted_quantile('v', ['district'], 0.5, 'p50')}),
c AS ({weighted_quantile('v', ['district'], 0.9, 'p90')})
SELECT a.district, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90
FROM a JOIN b ON a.district = b.district JOIN c ON a.district = c.district""")
def _percentiles(t):
    from almenara.operators.ordered import weighted_quantiles

    out = weighted_quantiles(
        t.access.filter(acc.valid_time()), ["district"], "t_min", "weight",
        {"p10": 0.1, "p50": 0.5, "p90": 0.9},
    )
    return out.select("district", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("poverty_lookup", ("poverty",), """SELECT lpad(CAST(district_int AS VARCHAR), 6, '0') AS ubigeo,
try_cast(trim(rate_raw) AS DOUBLE) AS poverty_rate FROM poverty WHERE try_cast(trim(rate_raw) AS DOUBLE) IS NOT NULL""")
def _poverty(t):
    return ops.load_poverty(t.poverty)


_JOINED_SQL = f"""{_DISTRICTS}, jo AS (SELECT u.region, lpad(CAST(u.district AS VARCHAR), 6, '0') AS ubigeo, u.weight, u.t_mean,
  try_cast(trim(rate_raw) AS DOUBLE) AS poverty_rate FROM du u LEFT JOIN poverty p ON p.district_int = u.district),
md AS (SELECT quantile_cont(t_mean, 0.5) AS mt, quantile_cont(poverty_rate, 0.5) AS mp FROM jo WHERE t_mean IS NOT NULL AND poverty_rate IS NOT NULL),
qu AS (SELECT jo.*, CASE WHEN t_mean > mt AND poverty_rate > mp THEN 'doble carga: lejos y pobre'
  WHEN t_mean > mt AND poverty_rate <= mp THEN 'lejos pero menos pobre' WHEN t_mean <= mt AND poverty_rate > mp THEN 'cerca pero pobre'
  WHEN t_mean <= mt AND poverty_rate <= mp THEN 'cerca y menos pobre' ELSE 'sin dato' END AS quadrant FROM jo, md)"""


def _joined(t):
    """Both medians and the join read the unit table, so it is stored once, as a job would."""
    units = pin(_units(t)).select(
        "region", F.lpad(F.col("district").cast("string"), 6, "0").alias("ubigeo"), "weight", "t_mean"
    )
    return ops.join_poverty(units, ops.load_poverty(t.poverty))


@query("access_by_poverty", ("access", "poverty"), f"{_JOINED_SQL} SELECT * FROM qu")
def _quadrants(t):
    return _joined(t)


@query("left_out_of_poverty_join", ("access", "poverty"), f"""{_JOINED_SQL}
SELECT count(*) FILTER (WHERE poverty_rate IS NULL AND t_mean IS NOT NULL) AS without_rate,
count(*) FILTER (WHERE t_mean IS NULL AND poverty_rate IS NOT NULL) AS without_time,
count(*) FILTER (WHERE t_mean IS NULL AND poverty_rate IS NULL) AS without_both, count(*) AS units FROM qu""")
def _left_out(t):
    return ops.left_out_of_join(_joined(t))


@query("largest_double_burden", ("access", "poverty"), f"""{_JOINED_SQL}
SELECT * FROM qu WHERE quadrant = 'doble carga: lejos y pobre' ORDER BY weight DESC, ubigeo LIMIT 6""")
def _largest(t):
    return ops.largest_in_quadrant(_joined(t))


_CORR_SQL = f"""{_JOINED_SQL}, cs AS (SELECT CAST(region AS VARCHAR) AS scope, * FROM qu UNION ALL SELECT 'TOTAL', * FROM qu),
rk AS (SELECT scope, poverty_rate, t_mean,
  rank() OVER (PARTITION BY scope ORDER BY poverty_rate) + (count(*) OVER (PARTITION BY scope, poverty_rate) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY scope ORDER BY t_mean) + (count(*) OVER (PARTITION BY scope, t_mean) - 1) / 2.0 AS ry
  FROM cs WHERE poverty_rate IS NOT NULL AND t_mean IS NOT NULL)"""


@query("poverty_correlations", ("access", "poverty"), f"""{_CORR_SQL}
SELECT scope, count(*) AS units, {rnd('corr(poverty_rate, t_mean)', 3)} AS pearson_r, {rnd('corr(rx, ry)', 3)} AS spearman_rho,
{rnd('avg(poverty_rate)', 1)} AS poverty_mean FROM rk GROUP BY scope HAVING count(*) >= 4""")
def _correlations(t):
    return ops.poverty_correlations(_joined(t)).drop("pearson_p", "spearman_p")


def _p_sql(r: str) -> str:
    """Two-sided p-value of a correlation of ``units`` pairs: the tail of Student's t as an integral of cosines."""
    at = f"asin(least(abs({r}), 1.0))"
    tail = f"sum(pow(cos({at} + f * (pi() / 2 - {at})), units - 3)) * (pi() / 2 - {at})"
    return f"(SELECT {tail} / (sum(pow(cos(f * pi() / 2), units - 3)) * pi() / 2) FROM grid)"


@query("poverty_correlation_p_values", ("access", "poverty"), f"""{_CORR_SQL},
grid AS (SELECT (i + 0.5) / 4000 AS f FROM range(4000) x(i)),
co AS (SELECT scope, count(*) AS units, corr(poverty_rate, t_mean) AS r, corr(rx, ry) AS s, avg(poverty_rate) AS m FROM rk GROUP BY scope HAVING count(*) >= 4)
SELECT scope, units, {rnd('r', 3)} AS pearson_r, {rnd(_p_sql('r'), 4)} AS pearson_p, {rnd('s', 3)} AS spearman_rho, {rnd(_p_sql('s'), 4)} AS spearman_p,
{rnd('m', 1)} AS poverty_mean FROM co""")
def _p_values(t):
    return ops.poverty_correlations(_joined(t))


@query("weight_time_rank_correlation", ("access",), """, r AS (SELECT region, weight, t_min,
  rank() OVER (PARTITION BY region ORDER BY weight) + (count(*) OVER (PARTITION BY region, weight) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY region ORDER BY t_min) + (count(*) OVER (PARTITION BY region, t_min) - 1) / 2.0 AS ry
  FROM access WHERE t_min IS NOT NULL)
SELECT region, count(*) AS rows, round(corr(weight, t_min), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho FROM r GROUP BY region""")
def _rank_correlation(t):
    out = ops.correlations(t.access, ["region"], "weight", "t_min")
    return out.select("region", "rows", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"))
