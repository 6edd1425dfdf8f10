"""Statistics of a player's games: ``game_id, ts, mode, colour, rating, result, ending``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import pct, rounded
from almenara.settings import ENDING_LABELS


def result_shares(games: DataFrame) -> DataFrame:
    """Games per result and their share of all games."""
    total = games.agg(F.count("*").alias("n")).scalar()
    return games.groupBy("result").agg(F.count("*").alias("games")).withColumn("pct", pct(F.col("games"), total, 1))


def wins_by(games: DataFrame, key: str) -> DataFrame:
    wins = F.count_if(F.col("result") == "win")
    return games.groupBy(key).agg(F.count("*").alias("games"), wins.alias("wins"), pct(wins, F.count("*"), 1).alias("pct_wins"))


def rating_summary(games: DataFrame) -> DataFrame:
    """First and last rating in time, lowest, highest and mean."""
    at = F.struct("ts", "game_id")
    return games.agg(
        F.min_by("rating", at).alias("first"), F.max_by("rating", at).alias("last"),
        F.min("rating").alias("lowest"), F.max("rating").alias("highest"), rounded(F.avg("rating"), 1).alias("mean"),
    )


def ending_label(col: str = "ending"):
    pairs = [F.lit(x) for kv in ENDING_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))


def endings(games: DataFrame) -> DataFrame:
    """Losses and wins per ending as counts and as shares of all games; draws only count in the total."""
    total = games.agg(F.count("*").alias("n")).scalar()
    decided = games.filter(F.col("result") != "draw").withColumn("ending_label", ending_label())
    losses, wins = F.count_if(F.col("result") == "loss"), F.count_if(F.col("result") == "win")
    return decided.groupBy("ending_label").agg(losses.alias("losses"), wins.alias("wins")).withColumns({
        "pct_wins": pct(F.col("wins"), total, 1), "pct_losses": pct(F.col("losses"), total, 1),
    })
