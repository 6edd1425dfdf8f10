"""Daily series with carry-forward over a complete calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUBLISHED, CARRIED, NO_DATA = "publicado", "arrastrado", "sin_dato"


def daily_carry_forward(
    quotes: DataFrame, series: str, day: str, values: list[str],
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """One row per calendar day and series; a day without a quote repeats the last published one.

    ``quotes`` has one row per (series, day). The calendar runs from ``start`` to ``end``, or from
    the first to the last quote of each series. A window holds the days of one series.
    """
    lo = F.lit(start).cast("date") if start else F.min(day)
    hi = F.lit(end).cast("date") if end else F.max(day)
    spine = quotes.groupBy(series).agg(lo.alias("_lo"), hi.alias("_hi")).select(
        series, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day)
    )
    so_far = Window.partitionBy(series).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    joined = spine.join(quotes.withColumn("_q", F.lit(True)), [series, day], "left")
    packed = F.struct(F.col(day).alias("d"), *[F.col(v) for v in values])
    last = F.last(F.when(F.col("_q"), packed), ignorenulls=True).over(so_far)
    return joined.select(series, day, "_q", last.alias("_l")).select(
        series, day, *[F.col(f"_l.{v}").alias(v) for v in values],
        F.when(F.col("_q"), PUBLISHED).when(F.col("_l").isNotNull(), CARRIED).otherwise(NO_DATA).alias("origin"),
        F.col("_l.d").alias("value_day"),
    )


def series_summary(daily: DataFrame, series: str) -> DataFrame:
    origin = F.col("origin")
    return daily.groupBy(series).agg(
        F.count("*").alias("days"), F.count_if(origin == PUBLISHED).alias("published"),
        F.count_if(origin == CARRIED).alias("carried"), F.count_if(origin == NO_DATA).alias("without_data"),
    )
