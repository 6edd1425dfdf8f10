"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "\t\n\x0b\x0c\r "


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; texts of single bytes take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def count_between(text: Column, separators: str) -> Column:
    """How many non-empty pieces ``separators`` (a pattern of one or more characters) leaves; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    edge = lambda k: F.when(F.element_at(parts, k) == "", 1).otherwise(0)  # noqa: E731  only the ends can be empty
    return F.when(F.size(parts) == 1, 1 - edge(1)).otherwise(F.size(parts) - edge(1) - edge(-1)).cast("long")


def first_bits(text: Column, bits: int) -> Column:
    """The first bits of the MD5 sum of a text, as a number of 0 or more."""
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), 48 - bits)


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted and has ``bound`` rows at most; else Spark joins as it sees fit."""
    return F.broadcast(df) if rows <= bound else df
