"""A bounded sample of labelled texts, drawn without moving the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, sample_rows: int, key: str, text: str, label: str) -> tuple[DataFrame, int]:
    """(text, label, h) of about ``sample_rows`` labelled rows at most, and how many labels were drawn.

    Rows are drawn by a hash of the key, from labels 0 and 1 alone, before they meet the texts; the drawn keys, whose
    number is the bound, are broadcast. A key that stands on several texts gives the one with the smallest hash, once;
    of equal texts with equal labels one key stays.
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).distinct()
    marks = marks.withColumn("h", F.xxhash64(F.col("_key").cast("string")))
    total = marks.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = marks.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1.0))
    rows = documents.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("_id") == F.col("_key")).select("text", "label", "h")
    # One row per drawn key and label: no more than were drawn.
    own = rows.groupBy("h", "label").agg(F.min(F.xxhash64("text")).alias("_t"))
    first = own.groupBy("_t", F.col("label").alias("_label")).agg(F.min("h").alias("_h"))
    kept = rows.join(F.broadcast(first), (F.xxhash64("text") == F.col("_t")) & (F.col("label") == F.col("_label")) & (F.col("h") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["h", "label"]), min(total, sample_rows)
