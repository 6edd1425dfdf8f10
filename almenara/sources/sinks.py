"""Writers, the append-only call log and the cache of computed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almenara.operators.index import read_index

LOG_COLUMNS = (
    "call_id", "ts", "task", "model", "band", "tokens_in", "tokens_hit", "tokens_out", "tokens_total", "latency_s",
    "cost_usd", "ok",
)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet table, optionally one folder per partition value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_calls(costed: DataFrame, path: str) -> None:
    """Add rows to the call log; rows are never rewritten."""
    costed.select(*[c for c in LOG_COLUMNS if c in costed.columns]).write.mode("append").parquet(path)


# ---------------------------------------------------------------- cache of computed tables
def fingerprint(df: DataFrame, key: str) -> Column:
    """Scalar that depends on the set of keys, not on their order or partitioning."""
    k = F.col(key).cast("string")
    a, b = F.xxhash64(k), F.xxhash64(F.concat(F.lit("|"), k))
    return df.agg(F.concat_ws(
        ":", F.count("*").cast("string"), F.bit_xor(a).cast("string"), F.bit_xor(b).cast("string"),
        F.sum(F.pmod(a, F.lit(2**31))).cast("string"),
    ).alias("f")).scalar()


def cache_key(profile: str, origins: DataFrame, destinations: DataFrame, origin_key: str, destination_key: str) -> str:
    """Key of a travel table: profile and the two sets of ids."""
    parts = F.concat_ws("#", F.lit(profile), fingerprint(origins, origin_key), fingerprint(destinations, destination_key))
    return origins.sparkSession.range(1).select(F.sha2(parts, 256).alias("k")).first()["k"][:16]


def cached_table(
    spark: SparkSession, folder: str, key: str, compute: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The stored table for ``key``, computed and stored the first time or when forced."""
    path = f"{folder.rstrip('/')}/key={key}"
    stored = None if force else read_index(spark, path)
    if stored is not None:
        return stored
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
