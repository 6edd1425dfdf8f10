"""Stratified, weighted sampling with a fixed number of points and expansion weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almenara.operators.ordered import top_n
from almenara.session import pin
from almenara.settings import ACCESS


def quotas(points: DataFrame, cap: int = ACCESS.sample_cap, by: str = "district") -> DataFrame:
    """Points to draw per stratum: one each, the rest in proportion to weight by largest remainder.

    Seats that rounding or a small stratum leaves over go one at a time to strata with room, by
    decreasing remainder, round after round. Round ``s`` of stratum ``d`` is slot ``(s, d)``, so
    the outcome is the first so many slots in order of round, remainder and stratum. The one row per
    stratum is stored, because the totals are read from it several times.
    """
    strata = pin(points.groupBy(by).agg(F.count("*").alias("available"), F.sum("weight").alias("_w")))
    totals = strata.agg(F.count("*").alias("k"), F.sum("_w").alias("w"))
    budget = F.lit(cap) - totals.select("k").scalar()
    checked = F.when(budget < 0, F.raise_error(F.lit(f"a cap of {cap} cannot give every stratum one point"))).otherwise(budget)
    exact = F.coalesce(F.try_divide(checked * F.col("_w"), totals.select("w").scalar()), F.lit(0.0))
    shared = strata.withColumn("_exact", exact).withColumn(
        "_extra", F.least(F.floor("_exact"), F.col("available") - 1)
    ).withColumns({
        "_spare": F.col("available") - 1 - F.col("_extra"), "_rest": F.col("_exact") - F.floor("_exact"),
    })
    left = F.lit(cap) - shared.agg(F.sum(F.col("_extra") + 1).alias("s")).scalar()
    slots = (
        shared.filter("_spare > 0")
        .select(by, "_rest", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_spare"), F.lit(cap)))).alias("_s"))
        .orderBy("_s", F.desc("_rest"), by).limit(cap)
        .withColumn("_seat", F.row_number().over(_one_window(by))).filter(F.col("_seat") <= left)
        .groupBy(by).agg(F.count("*").alias("_more"))
    )
    return shared.join(slots, by, "left").select(
        by, "available", (F.lit(1) + F.col("_extra") + F.coalesce("_more", F.lit(0))).alias("quota")
    )


def _one_window(by: str):
    """Numbers the at most ``cap`` slots that are left after the limit."""
    return Window.partitionBy(F.lit(0)).orderBy("_s", F.desc("_rest"), by)


def draw_key(key: str, weight: str, seed: int):
    """Efraimidis-Spirakis key from a hash of the id: the draw does not depend on partitioning."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.ln(u) / F.greatest(F.col(weight).cast("double"), F.lit(1e-9))


#: Draw keys are counted in buckets of 1/1024 on a logarithmic scale, so the bucket at an edge holds about a thousandth of a stratum.
STEPS = 1024
#: The scale ends at this power of e; keys beyond share the outermost buckets.
END = 64


def _bucket() -> Column:
    """The bucket of the draw key, smaller for keys that are drawn earlier."""
    place = F.coalesce(F.ln(-F.col("_key")), F.lit(float(-END)))
    return F.floor(F.greatest(F.least(place, F.lit(float(END))), F.lit(float(-END))) * STEPS).cast("int")


def _edges(rows: DataFrame, need: DataFrame, by: str) -> DataFrame:
    """The bucket in which a stratum's ``_need`` ends, and how many rows of that bucket are still needed.

    Only counts per bucket, at most ``2 * END * STEPS`` a stratum, are brought together. A stratum that has no more rows
    than it needs has no edge.
    """
    counts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")))
    before = F.col("_upto") - F.col("_n")
    return upto.join(need, by).filter((F.col("_upto") > F.col("_need")) & (before <= F.col("_need"))).select(
        by, F.col("_bucket").alias("_edge"), (F.col("_need") - before).alias("_need")
    )


def draw_sample(
    points: DataFrame, cap: int = ACCESS.sample_cap, seed: int = ACCESS.seed,
    by: str = "district", key: str = "point_id",
) -> DataFrame:
    """The heaviest point of each stratum and a weighted draw of the rest, up to the quota.

    A stratum's quota is a threshold on its draw keys, found from a histogram. Points are filtered where they lie,
    whatever the cap; only those of the bucket at the edge are ranked.
    """
    heaviest = points.groupBy(by).agg(F.max(F.struct(F.col("weight"), (-F.col(key)).alias("m"))).alias("_h"))
    need = quotas(points, cap, by).select(by, (F.col("quota") - 1).alias("_need"))
    ready = points.join(heaviest, by).withColumns({
        "_forced": F.col(key) == -F.col("_h.m"), "_key": F.round(draw_key(key, "weight", seed), 12),
    }).drop("_h")
    rest = ready.filter(~F.col("_forced")).withColumn("_bucket", _bucket())
    # One row per stratum, read by both filters below.
    marked = rest.join(F.broadcast(pin(_edges(rest, need, by))), by, "left")
    inside = F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge"))
    last = marked.filter(F.col("_bucket") == F.col("_edge"))
    ranked = top_n(last, [by], [F.desc("_key"), F.asc(key)], cap, spread=[key], rank="_rank").filter(F.col("_rank") <= F.col("_need"))
    forced, early, at_edge = (part.select(*points.columns) for part in (ready.filter("_forced"), marked.filter(inside), ranked))
    return forced.unionByName(early).unionByName(at_edge)


def expansion_weights(sample: DataFrame, points: DataFrame, by: str = "district") -> DataFrame:
    """``sample_weight`` adds up to the stratum total; a stratum without weight is split evenly."""
    total = points.groupBy(by).agg(F.sum("weight").alias("_total"))
    drawn = sample.groupBy(by).agg(F.sum("weight").alias("_drawn"), F.count("*").alias("_n"))
    return sample.join(total, by).join(drawn, by).withColumn(
        "sample_weight",
        F.when(F.col("_drawn") == 0, F.col("_total") / F.col("_n"))
        .otherwise(F.col("weight") * F.col("_total") / F.nullif(F.col("_drawn"), F.lit(0.0))),
    ).drop("_total", "_drawn", "_n")
