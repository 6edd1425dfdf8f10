"""Comparison of two snapshots of a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import true


def compare_snapshots(current: DataFrame, previous: DataFrame, key: str = "facility_id") -> DataFrame:
    """(indicator, value) rows from one full outer join on the unique key."""
    cols = ("category", "state", "resolutive")
    a = current.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    b = previous.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    a_in, b_in = true("in_a"), true("in_b")
    both = a_in & b_in
    now, before = true("a_resolutive"), true("b_resolutive")
    counts = {
        "establecimientos_corte_anterior": b_in,
        "establecimientos_corte_actual": a_in,
        "altas_nuevas": a_in & ~b_in,
        "bajas_desaparecidas": b_in & ~a_in,
        "cambio_de_categoria": both & (F.col("a_category") != F.col("b_category")),
        "cambio_de_estado": both & (F.col("a_state") != F.col("b_state")),
        "resolutivos_corte_anterior": before,
        "resolutivos_corte_actual": now,
        "ganaron_capacidad_resolutiva": both & now & ~before,
        "perdieron_capacidad_resolutiva": both & before & ~now,
    }
    rows = [F.struct(F.lit(n).alias("indicator"), F.count_if(true(c)).alias("value")) for n, c in counts.items()]
    return a.join(b, key, "full_outer").agg(F.array(*rows).alias("r")).select(F.inline("r"))


def key_sets(current: DataFrame, previous: DataFrame, key: str = "facility_id") -> DataFrame:
    """Every key with its membership: both snapshots, only the current one, only the previous one."""
    seen = current.select(key, F.lit(1).alias("m")).unionByName(previous.select(key, F.lit(2).alias("m")))
    return seen.groupBy(key).agg(F.bit_or("m").alias("m")).select(
        key, F.element_at(F.array(F.lit("alta"), F.lit("baja"), F.lit("comun")), F.col("m")).alias("membership")
    )
