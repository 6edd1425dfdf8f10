"""Shards by rendezvous hashing of record keys over weighted shards.

A record draws a number in (0, 1) for every shard from the MD5 sum of key and shard number and goes to the shard with
the largest weight / -ln(draw): a shard's share is its weight's share, and a further shard takes records only into
itself. Key and shards decide alone; no record looks at another, so nothing moves to find the shard.

Slots number the records of a shard from 0 without a gap. A shard is cut into 2**CUT parts by the hash of key, size
and checksum; parts are counted, and the running totals (shards x 2**CUT rows, whatever the table's size) give each
part its first slot. Equal rows are counted once with their number and spread again at the end, ``SPREAD`` at a time,
so one key may hold any share of the rows, with one text or with many.

A null key is a key like any other. Null text has no bytes and checksum 0. Ties between rows of one key are broken by
size and checksum; equal rows get consecutive slots. Columns ``shard`` and ``grown_shard`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almenara.llm.columns import first_bits

CUT = 12
SHARDS = 16
SPREAD = 10_000


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def best_shard(key: str, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the record; ties go to the smaller number."""
    offers = []
    for shard, weight in enumerate(weights):
        draw = (first_bits(F.concat(_key(key), F.lit(f":{shard}")), 48) + 0.5) / float(1 << 48)
        offers.append(F.struct((F.lit(float(weight)) / -F.log(draw)).alias("score"), F.lit(-shard).alias("back")))
    return -F.array_max(F.array(*offers))["back"] if len(offers) > 1 else F.lit(0)


def assign(documents: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, further: float | None = 1.0) -> DataFrame:
    """``documents`` with ``shard`` and, if ``further`` is a weight, the shard after one more of it is added."""
    kept = [c for c in documents.columns if c not in ("shard", "grown_shard")]
    shard = best_shard(key, weights).cast("int")
    grown = best_shard(key, [*weights, further]).cast("int") if further is not None else F.lit(None).cast("int")
    return documents.select(*kept, shard.alias("shard"), grown.alias("grown_shard"))


def placed(documents: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, further: float | None = 1.0) -> DataFrame:
    """One row per record: key, size in bytes plus 1, checksum, shard, slot, and the shard after growing."""
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("_key"), (F.octet_length(clean) + 1).cast("long").alias("size"), F.crc32(clean.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = assign(rows, "_key", weights, further).withColumn("part", first_bits(F.concat_ws(":", _key("_key"), "size", "text_crc32"), CUT))
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("shard").orderBy("part"))
    # At most shards x 2**CUT rows.
    first = F.broadcast(counts.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), (upto - F.col("m")).alias("base")))
    order = Window.partitionBy("shard", "part").orderBy(F.col("_key").isNotNull(), "_key", "size", "text_crc32")
    numbered = rows.withColumn("upto", F.sum("n").over(order)).join(first, (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part")))
    start = F.col("base") + F.col("upto") - F.col("n")
    kept = [F.col("_key").alias(key), "size", "text_crc32", "shard"]
    runs = numbered.withColumn("end", start + F.col("n") - 1).withColumn("start", F.explode(F.sequence(start, F.col("end"), F.lit(SPREAD).cast("long"))))
    return runs.select(*kept, F.explode(F.sequence("start", F.least(F.col("start") + SPREAD - 1, F.col("end")))).alias("slot"), "grown_shard")
