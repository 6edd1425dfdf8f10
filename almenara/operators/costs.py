"""Cost of model calls under a tariff that depends on the hour, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import rounded
from almenara.operators.ordered import null_safe_join, quantiles, sums_by_level, with_levels
from almenara.settings import PEAK_HOURS_UTC, TARIFFS

PEAK, OFF_PEAK = "pico", "valle"


def price_table(spark) -> DataFrame:
    """Nested price map as (band, item, price) rows."""
    nested = F.create_map(*[
        x for band, items in TARIFFS.items()
        for x in (F.lit(band), F.create_map(*[F.lit(y) for kv in items.items() for y in kv]))
    ])
    return spark.range(1).select(F.explode(nested).alias("band", "items")).select(
        "band", F.explode("items").alias("item", "usd_per_million")
    )


def tariff_band(ts: Column, hours=PEAK_HOURS_UTC, weekdays_only: bool = True) -> Column:
    """Peak inside one of the half-open UTC hour ranges on a working day, off-peak otherwise."""
    minute = F.hour(ts) * 60 + F.minute(ts)

    def at(text: str) -> int:
        h, m = text.split(":")
        return int(h) * 60 + int(m)

    inside = F.lit(False)
    for start, end in hours:
        inside = inside | ((minute >= at(start)) & (minute < at(end)))
    working = F.weekday(ts) < 5 if weekdays_only else F.lit(True)
    return F.when(working & inside, PEAK).otherwise(OFF_PEAK)


def call_cost(band: Column, tokens_in: Column, tokens_hit: Column, tokens_out: Column) -> Column:
    """Cached input, remaining input and output tokens at the price of the band, per million."""
    def price(item: str) -> Column:
        return F.when(band == PEAK, TARIFFS[PEAK][item]).otherwise(TARIFFS[OFF_PEAK][item])

    rest = F.greatest(tokens_in - tokens_hit, F.lit(0))
    return (
        tokens_hit / 1e6 * price("entrada_cache_hit") + rest / 1e6 * price("entrada_cache_miss")
        + tokens_out / 1e6 * price("salida")
    )


def add_costs(calls: DataFrame) -> DataFrame:
    c = F.col
    priced = calls.withColumns({"band": tariff_band(c("ts")), "tokens_total": c("tokens_in") + c("tokens_out")})
    cost = call_cost(c("band"), c("tokens_in"), c("tokens_hit"), c("tokens_out"))
    return priced.withColumns({"latency_s": rounded(c("latency_s"), 3), "cost_usd": rounded(cost, 8)})


def cost_summary(costed: DataFrame) -> DataFrame:
    """Calls, tokens, median latency and cost per task, model and band, plus the grand total."""
    levels = {"group": ["task", "model", "band"], "TOTAL": []}
    by = ["level", "task", "model", "band"]
    sums = sums_by_level(costed, levels, {
        "calls": F.count("*"), "ok_calls": F.count_if("ok"), "failed_calls": F.count_if(~F.col("ok")),
        "tokens_in": F.sum("tokens_in"), "tokens_out": F.sum("tokens_out"), "cost_usd": F.sum("cost_usd"),
    })
    q = quantiles(with_levels(costed, levels), by, "latency_s", {"latency_median_s": 0.5})
    return null_safe_join(sums, q, by, "left").withColumns({
        "cost_usd": rounded(F.col("cost_usd"), 6), "latency_median_s": rounded(F.col("latency_median_s"), 2),
    })
