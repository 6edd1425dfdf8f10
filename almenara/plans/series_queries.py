"""Queries on daily series, games and call costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.operators import costs, games, series
from almenara.plans.oracle_text import pct, rnd
from almenara.plans.registry import query

_DAILY = """sp AS (SELECT currency, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM
  (SELECT currency, CAST(min(d) AS TIMESTAMP) AS lo, CAST(max(d) AS TIMESTAMP) AS hi FROM quotes GROUP BY currency) x),
dj AS (SELECT sp.currency, sp.d, q.buy, q.sell, q.d AS qd FROM sp LEFT JOIN quotes q ON sp.currency = q.currency AND sp.d = q.d),
dl AS (SELECT currency, d, last_value(buy IGNORE NULLS) OVER w AS buy, last_value(sell IGNORE NULLS) OVER w AS sell,
  CASE WHEN qd IS NOT NULL THEN 'publicado' WHEN last_value(qd IGNORE NULLS) OVER w IS NOT NULL THEN 'arrastrado' ELSE 'sin_dato' END AS origin,
  last_value(qd IGNORE NULLS) OVER w AS value_day FROM dj WINDOW w AS (PARTITION BY currency ORDER BY d ROWS UNBOUNDED PRECEDING))"""


def _daily(t):
    return series.daily_carry_forward(t.quotes, "currency", "d", ["buy", "sell"])


@query("daily_carry_forward", ("quotes",), f", {_DAILY} SELECT * FROM dl")
def _carry(t):
    return _daily(t)


@query("daily_series_summary", ("quotes",), f""", {_DAILY} SELECT currency, count(*) AS days, count(*) FILTER (WHERE origin = 'publicado') AS published,
count(*) FILTER (WHERE origin = 'arrastrado') AS carried, count(*) FILTER (WHERE origin = 'sin_dato') AS without_data FROM dl GROUP BY currency""")
def _series_summary(t):
    return series.series_summary(_daily(t), "currency")


@query("game_results", ("games",), f"SELECT result, count(*) AS games, {pct('count(*)', '(SELECT count(*) FROM games)', 1)} AS pct FROM games GROUP BY result")
def _results(t):
    return games.result_shares(t.games)


def _wins_sql(key: str) -> str:
    w = "count(*) FILTER (WHERE result = 'win')"
    return f"SELECT {key}, count(*) AS games, {w} AS wins, {pct(w, 'count(*)', 1)} AS pct_wins FROM games GROUP BY {key}"


@query("games_by_colour", ("games",), _wins_sql("colour"))
def _by_colour(t):
    return games.wins_by(t.games, "colour")


@query("games_by_mode", ("games",), _wins_sql("mode"))
def _by_mode(t):
    return games.wins_by(t.games, "mode")


@query("rating_summary", ("games",), f"""SELECT arg_min(rating, {{'t': ts, 'i': game_id}}) AS first, arg_max(rating, {{'t': ts, 'i': game_id}}) AS last,
min(rating) AS lowest, max(rating) AS highest, {rnd('avg(rating)', 1)} AS mean FROM games""")
def _rating(t):
    return games.rating_summary(t.games)


@query("game_endings", ("games",), f"""SELECT CASE ending WHEN 'mate' THEN 'Jaque mate' WHEN 'resign' THEN 'Rendicion' WHEN 'outoftime' THEN 'Tiempo' ELSE ending END AS ending_label,
count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'win') AS wins,
{pct("count(*) FILTER (WHERE result = 'win')", '(SELECT count(*) FROM games)', 1)} AS pct_wins,
{pct("count(*) FILTER (WHERE result = 'loss')", '(SELECT count(*) FROM games)', 1)} AS pct_losses FROM games WHERE result <> 'draw' GROUP BY 1""")
def _endings(t):
    return games.endings(t.games)


_COST = f"""cb AS (SELECT *, CASE WHEN isodow(ts) <= 5 AND ((hour(ts) >= 1 AND hour(ts) < 4) OR (hour(ts) >= 6 AND hour(ts) < 10)) THEN 'pico' ELSE 'valle' END AS band FROM calls),
cc AS (SELECT * REPLACE ({rnd('latency_s', 3)} AS latency_s), tokens_in + tokens_out AS tokens_total,
  {rnd('''tokens_hit / 1e6 * CASE WHEN band = 'pico' THEN 0.006 ELSE 0.003 END
    + greatest(tokens_in - tokens_hit, 0) / 1e6 * CASE WHEN band = 'pico' THEN 0.30 ELSE 0.15 END
    + tokens_out / 1e6 * CASE WHEN band = 'pico' THEN 1.20 ELSE 0.60 END''', 8)} AS cost_usd FROM cb)"""


@query("call_costs", ("calls",), f", {_COST} SELECT call_id, band, tokens_total, latency_s, cost_usd FROM cc")
def _costs(t):
    return costs.add_costs(t.calls).select("call_id", "band", "tokens_total", "latency_s", "cost_usd")


@query("cost_summary", ("calls",), f""", {_COST} SELECT CASE WHEN grouping(task) = 1 THEN 'TOTAL' ELSE 'group' END AS level, task, model, band,
count(*) AS calls, count(*) FILTER (WHERE ok) AS ok_calls, count(*) FILTER (WHERE NOT ok) AS failed_calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
{rnd('sum(cost_usd)', 6)} AS cost_usd, {rnd('quantile_cont(latency_s, 0.5)', 2)} AS latency_median_s FROM cc GROUP BY GROUPING SETS ((task, model, band), ())""")
def _cost_summary(t):
    return costs.cost_summary(costs.add_costs(t.calls))


@query("cost_by_price_table", ("calls",), f""", {_COST} SELECT band, item, round(sum(tokens) / 1e6 * any_value(price), 6) AS cost_usd FROM (
SELECT band, 'entrada_cache_hit' AS item, tokens_hit AS tokens, CASE WHEN band = 'pico' THEN 0.006 ELSE 0.003 END AS price FROM cb
UNION ALL SELECT band, 'entrada_cache_miss', greatest(tokens_in - tokens_hit, 0), CASE WHEN band = 'pico' THEN 0.30 ELSE 0.15 END FROM cb
UNION ALL SELECT band, 'salida', tokens_out, CASE WHEN band = 'pico' THEN 1.20 ELSE 0.60 END FROM cb) x GROUP BY band, item""")
def _by_price(t):
    c = F.col
    used = costs.add_costs(t.calls).groupBy("band").agg(
        F.sum("tokens_hit").alias("entrada_cache_hit"),
        F.sum(F.greatest(c("tokens_in") - c("tokens_hit"), F.lit(0))).alias("entrada_cache_miss"),
        F.sum("tokens_out").alias("salida"),
    ).unpivot(["band"], ["entrada_cache_hit", "entrada_cache_miss", "salida"], "item", "tokens")
    prices = costs.price_table(t.spark)
    return used.join(F.broadcast(prices), ["band", "item"]).select(
        "band", "item", F.round(c("tokens") / 1e6 * c("usd_per_million"), 6).alias("cost_usd")
    )
