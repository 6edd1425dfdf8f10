"""Access to services: nearest destination, coverage, gaps and what-if scenarios.

An access table has one row per demand point: ``point_id, region, district, weight, t_min,
reachable, off_network, urban``. A travel table has ``point_id, facility_id, mode, duration_s,
distance_m``; a pair that is absent or has a NULL duration is unreachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import pct, rounded, true
from almenara.operators.ordered import (
    collapsed_weighted_quantiles, null_safe_join, quantiles, quantiles_of, running_sums, sums_by_level, weighted_quantiles, with_levels,
)
from almenara.settings import ACCESS, ACTIVE_STATES, UPGRADABLE_CATEGORIES

TOTAL = "TOTAL"
NO_ACCESS = "Sin acceso vial"
BAND_LABELS = ("≤30 min", "30-60 min", "60-120 min", ">120 min", NO_ACCESS)


# ---------------------------------------------------------------- predicates on one row
def valid_time() -> Column:
    """The travel time can be interpreted: reachable, served by the network and known."""
    return true("reachable") & ~true("off_network") & F.col("t_min").isNotNull()


def no_access() -> Column:
    """Unreachable or off the network, whatever the time says."""
    return ~true("reachable") | true("off_network")


def time_band(t: Column, without_access: Column, bands: tuple[int, ...] = ACCESS.bands_min) -> Column:
    """Label of the coverage band; ``bands`` are the upper edges of all but the last two labels."""
    label = F.when(without_access | t.isNull(), BAND_LABELS[-1])
    for edge, name in zip(bands, BAND_LABELS, strict=False):
        label = label.when(t <= edge, name)
    return label.otherwise(BAND_LABELS[len(bands)])


def group_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per group (NULL groups left out) and in total, labelled ``group_name``."""
    out = sums_by_level(df, {"group": [key], TOTAL: []}, sums)
    out = out.filter((F.col("level") == TOTAL) | F.col(key).isNotNull())
    return out.select(_group_label(key).alias("group_name"), *sums)


def _group_label(key: str) -> Column:
    return F.when(F.col("level") == TOTAL, TOTAL).otherwise(F.col(key).cast("string"))


# ---------------------------------------------------------------- nearest destination
def nearest_destination(pairs: DataFrame, by: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Fastest destination of every origin in one map-combined aggregation.

    Equal times go to the smaller destination id. Origins without any time stay, unreachable.
    """
    best = F.min(
        F.when(F.col("duration_s").isNotNull(), F.struct("duration_s", "facility_id", "distance_m"))
    )
    return pairs.groupBy(*by).agg(best.alias("b")).select(
        *by,
        F.col("b.facility_id").alias("nearest_id"),
        F.col("b.duration_s").alias("t_min_s"),
        F.col("b.distance_m").alias("dist_min_m"),
        (F.col("b.duration_s") / 60).alias("t_min_min"),
        F.col("b").isNotNull().alias("reachable"),
        F.when(F.col("b").isNotNull(), F.coalesce(F.col("b.distance_m") == 0, F.lit(False)))
        .alias("collapsed_trip"),
    )


def pair_completeness(origins: DataFrame, destinations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of the complete origin x destination table, counted without building it.

    Per origin: destinations, pairs with a time, and pairs that are unreachable. A destination or
    origin missing from ``pairs`` counts as unreachable, so the counts add up to the full product.
    """
    timed = (
        pairs.filter(F.col("duration_s").isNotNull())
        .join(destinations.select("facility_id").distinct(), "facility_id", "left_semi")
        .groupBy("point_id").agg(F.countDistinct("facility_id").alias("timed"))
    )
    total = destinations.select("facility_id").agg(F.countDistinct("facility_id").alias("n")).scalar()
    return (
        origins.select("point_id").distinct().join(timed, "point_id", "left")
        .select(
            "point_id", total.alias("destinations"),
            F.coalesce("timed", F.lit(0)).alias("timed"),
        )
        .withColumn("unreachable", F.col("destinations") - F.col("timed"))
    )


def mode_column(mode: object, what: str) -> str:
    return f"{what}_{mode}"


def compare_modes(nearest: DataFrame, demand: DataFrame, modes: dict[int, str], base: int) -> DataFrame:
    """One row per point with the nearest destination of each mode side by side.

    ``nearest`` has one row per (point, mode). ``changed_*`` is NULL where one of the two modes
    reaches nothing; ``ratio_*`` is NULL where the base time is 0.
    """
    def pick(m: int, field: str) -> Column:
        return F.max(F.when(F.col("mode") == m, F.col(field)))

    wide = nearest.groupBy("point_id").agg(
        *[pick(m, f).alias(f"{short}_{name}") for m, name in modes.items()
          for f, short in (("nearest_id", "id"), ("t_min_min", "t"), ("dist_min_m", "dist"))],
        *[F.coalesce(pick(m, "reachable"), F.lit(False)).alias(f"ok_{name}") for m, name in modes.items()],
    )
    out = demand.join(wide, "point_id", "left")
    b = modes[base]
    for m, name in modes.items():
        if m == base:
            continue
        both = true(f"ok_{name}") & true(f"ok_{b}")
        out = out.withColumns({
            f"changed_{name}": F.when(both, F.col(f"id_{name}") != F.col(f"id_{b}")),
            f"ratio_{name}": F.col(f"t_{name}") / F.nullif(F.col(f"t_{b}"), F.lit(0.0)),
        })
    return out


def mode_summary(compared: DataFrame, modes: dict[int, str], base: int, key: str = "region") -> DataFrame:
    """Per group: reachable points and median time per mode, share changed, ratio quantiles."""
    rows = compared.filter(F.col(key).isNotNull())
    others = [n for m, n in modes.items() if m != base]
    out = rows.groupBy(key).agg(
        F.count("*").alias("points"),
        *[F.count_if(true(f"ok_{n}")).alias(f"reachable_{n}") for n in modes.values()],
        *[rounded(100 * F.avg(F.col(f"changed_{n}").cast("int")), 1).alias(f"pct_changed_{n}") for n in others],
    )
    measures = {f"t_{n}": F.when(true(f"ok_{n}"), F.col(f"t_{n}")) for n in modes.values()}
    measures |= {f"ratio_{n}": F.col(f"ratio_{n}") for n in others}
    wanted = {f"t_median_{n}": (f"t_{n}", 0.5) for n in modes.values()}
    wanted |= {f"ratio_{label}_{n}": (f"ratio_{n}", q) for n in others for label, q in (("median", 0.5), ("p90", 0.9))}
    q = quantiles_of(rows, [key], measures, wanted)
    digits = {c: 1 if c.startswith("t_") else 2 for c in wanted}
    return out.join(q.select(key, *[rounded(F.col(c), d).alias(c) for c, d in digits.items()]), key, "left")


def urban_walking_access(points: DataFrame, walking_pairs: DataFrame) -> DataFrame:
    """Urban points with the nearest facility of any category on foot."""
    urban = points.filter(F.col("urban")).select("point_id", "region", "district", "weight")
    best = nearest_destination(walking_pairs.join(urban.select("point_id"), "point_id", "left_semi"))
    return urban.join(best, "point_id", "left").withColumn("reachable", true("reachable"))


def walking_summary(walking: DataFrame, key: str = "region") -> DataFrame:
    """Median and p90 over reachable points whose trip did not collapse to one network node."""
    ok = true("reachable") & ~true("collapsed_trip")
    counts = walking.groupBy(key).agg(
        F.count("*").alias("points"), F.count_if(ok).alias("valid_points"),
        F.count_if(true("collapsed_trip")).alias("collapsed"),
    )
    q = quantiles(walking.filter(ok), [key], "t_min_min", {"t_median": 0.5, "t_p90": 0.9})
    return null_safe_join(
        counts, q.select(key, rounded(F.col("t_median"), 1).alias("t_median"), rounded(F.col("t_p90"), 1).alias("t_p90")),
        [key], "left",
    )


# ---------------------------------------------------------------- network coverage
def classify_network_coverage(
    demand: DataFrame, snap: DataFrame, threshold_m: float = ACCESS.snap_threshold_m
) -> DataFrame:
    """Off network: the snap failed, or the network is further away than the threshold.

    A point without a snap row is off network as well.
    """
    return demand.join(snap.select("point_id", "snap_m", "snap_ok"), "point_id", "left").withColumns({
        "snap_ok": true("snap_ok"),
        "off_network": ~true("snap_ok") | true(F.col("snap_m") > threshold_m),
    })


def network_coverage_summary(covered: DataFrame, key: str = "region") -> DataFrame:
    off = true("off_network")
    sums = group_sums(covered, key, {
        "points": F.count("*"), "points_off": F.count_if(off),
        "_off": F.sum(F.when(off, F.col("weight")).otherwise(0.0)), "_all": F.sum("weight"),
    })
    return sums.select("group_name", "points", "points_off", pct(F.col("_off"), F.col("_all"), 1).alias("pct_weight_off"))


def snap_diagnostics(snap: DataFrame) -> DataFrame:
    """Counts and distance statistics of a snap table, one row."""
    ok = true("snap_ok")
    m = F.when(ok, F.col("snap_m"))
    stats = snap.agg(
        F.count("*").alias("points"), F.count_if(ok).alias("snapped"), F.count_if(~ok).alias("failed"),
        rounded(F.avg(m), 1).alias("mean_m"), rounded(F.max(m), 1).alias("max_m"),
        F.count_if(true(m > 1000)).alias("over_1km"), F.count_if(true(m > 5000)).alias("over_5km"),
    )
    q = quantiles(snap.filter(ok), [], "snap_m", {"median_m": 0.5, "p95_m": 0.95})
    return stats.withColumns({
        c: rounded(q.select(c).scalar(), 1) for c in ("median_m", "p95_m")
    })


def snap_sensitivity(
    covered: DataFrame, thresholds: tuple[int, ...] = ACCESS.snap_sweep_m,
    groups: tuple[object, ...] = (), key: str = "region",
) -> DataFrame:
    """Share off network per threshold, one column per group; every threshold in a single pass."""
    def off(t: int) -> Column:
        return ~true("snap_ok") | true(F.col("snap_m") > t)

    def weight_share(t: int, rows: Column) -> Column:
        w = F.when(rows, F.col("weight")).otherwise(0.0)
        return pct(F.sum(F.when(off(t), w).otherwise(0.0)), F.sum(w), 1)

    everyone = F.lit(True)
    per_threshold = [
        F.struct(
            F.lit(t).alias("threshold_m"), F.count_if(off(t)).alias("points_off"),
            pct(F.count_if(off(t)), F.count("*"), 1).alias("pct_points"),
            rounded(F.sum(F.when(off(t), F.col("weight")).otherwise(0.0)), 0).alias("weight_off"),
            weight_share(t, everyone).alias("pct_weight"),
            *[weight_share(t, F.col(key) == g).alias(f"pct_weight_{g}") for g in groups],
        )
        for t in thresholds
    ]
    return covered.agg(F.array(*per_threshold).alias("r")).select(F.inline("r"))


# ---------------------------------------------------------------- coverage and levels
def coverage_bands(
    access: DataFrame, bands: tuple[int, ...] = ACCESS.bands_min, key: str = "region"
) -> DataFrame:
    """Weight and share per travel-time band, for each group and the total."""
    ok, t, w = valid_time(), F.col("t_min"), F.col("weight")

    def weight_where(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0.0))

    edges = list(zip((None, *bands[:-1]), bands))
    sums = {
        f"{lo or 0}_{hi}": weight_where(ok & (t <= hi) & ((t > lo) if lo else F.lit(True)))
        for lo, hi in edges
    }
    sums[f"over_{bands[-1]}"] = weight_where(ok & (t > bands[-1]))
    sums["no_access"] = F.sum(w) - weight_where(ok)
    within = {b: weight_where(ok & (t <= b)) for b in bands}
    g = group_sums(access, key, {
        "_total": F.sum(w), **{f"_s_{n}": c for n, c in sums.items()}, **{f"_c_{b}": c for b, c in within.items()},
    })
    total = F.col("_total")
    return g.select(
        "group_name", rounded(total, 0).alias("weight_total"),
        *[rounded(F.col(f"_s_{n}"), 0).alias(f"weight_{n}") for n in sums],
        *[pct(F.col(f"_s_{n}"), total).alias(f"pct_{n}") for n in sums],
        *[pct(F.col(f"_c_{b}"), total).alias(f"pct_within_{b}") for b in bands],
    )


def _by_time(access: DataFrame, keys: list[str]) -> DataFrame:
    """One row per unit and valid time (NULL: none): what both sums and weighted quantiles need."""
    ok, w = valid_time(), F.col("weight")
    used = F.when(ok & (w > 0), w)
    return access.groupBy(*keys, F.when(ok, F.col("t_min").cast("double")).alias("_t")).agg(
        F.count("*").alias("_n"), F.sum(w).alias("_all"), F.sum(F.when(ok, w)).alias("_ok"),
        F.sum(used).alias("_used"), F.min(used).alias("_first"), F.max(used).alias("_last"),
    )


def aggregate_by_level(access: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Weighted time statistics per unit of every level; NULL keys form their own unit.

    Sums and quantiles come from the same collapsed rows: ``access`` is read and shuffled once.
    """
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    by = ["level", *keys]
    rows = _by_time(access, keys)
    sums = sums_by_level(rows, levels, {
        "points": F.sum("_n"), "_total": F.sum("_all"), "_with": F.sum(F.coalesce("_ok", F.lit(0.0))),
        "_vw": F.sum(F.col("_t") * F.col("_used")), "_w": F.sum("_used"),
        "_seen": F.count("_first") + F.count("_last"),  # reads what the quantiles read, so both share one shuffle
    })
    # A condition on a sum stays above the aggregation, where one on the time would split the two branches.
    q = collapsed_weighted_quantiles(
        with_levels(rows.filter(F.col("_used") > 0), levels), by, "_t", "_used", "_first", "_last",
        {"t_p50": 0.5, "t_p90": 0.9}, also=("_n", "_all", "_ok"),
    )
    return null_safe_join(sums, q, by, "left").select(
        *by, "points", rounded(F.col("_total"), 0).alias("weight"),
        rounded(F.col("_with"), 0).alias("weight_with_access"),
        pct(F.col("_total") - F.col("_with"), F.col("_total")).alias("pct_without_access"),
        rounded(F.try_divide("_vw", "_w"), 1).alias("t_mean"),
        rounded(F.col("t_p50"), 1).alias("t_p50"), rounded(F.col("t_p90"), 1).alias("t_p90"),
    )


def slowest_first(levels: DataFrame) -> DataFrame:
    return levels.orderBy(F.desc_nulls_first("t_mean"))


def critical_gaps(
    units: DataFrame, n: int = ACCESS.top_gaps, tie: tuple[str, ...] = ("region", "district")
) -> DataFrame:
    """The ``n`` worst units, ranked: most weight without access first, then the slowest."""
    from pyspark.sql.window import Window

    order = [F.desc_nulls_first("pct_without_access"), F.desc_nulls_first("t_mean"), *[F.asc(c) for c in tie]]
    worst = units.orderBy(*order).limit(n)
    return worst.withColumns({
        "ranking": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)),
        "weight_without_access": rounded(F.col("weight") * F.col("pct_without_access") / 100, 0),
    })


def worst_unit(units: DataFrame, tie: tuple[str, ...] = ("region", "district")) -> DataFrame:
    """The single worst unit; here a unit without a time sorts last."""
    return units.orderBy(
        F.desc_nulls_last("pct_without_access"), F.desc_nulls_last("t_mean"), *[F.asc(c) for c in tie]
    ).limit(1)


def urban_rural_contrast(access: DataFrame, key: str = "region") -> DataFrame:
    rows = access.withColumn("area", F.when(F.col("urban"), "urbano").when(~F.col("urban"), "rural"))
    out = aggregate_by_level(rows, {"area": [key, "area"]})
    return out.select(key, "area", "points", "weight", "pct_without_access", "t_mean", "t_p90")


def access_summary(access: DataFrame, key: str = "region") -> DataFrame:
    """Unreachable points, weight off the network and plain (unweighted) time quantiles per group."""
    rows = access.filter(F.col(key).isNotNull())
    reach, off, w = true("reachable"), true("off_network"), F.col("weight")
    sums = rows.groupBy(key).agg(
        F.count("*").alias("points"), rounded(F.sum(w), 0).alias("weight"),
        pct(F.count_if(~reach), F.count("*"), 1).alias("pct_unreachable"),
        pct(F.sum(F.when(off, w).otherwise(0.0)), F.sum(w), 1).alias("pct_weight_off_network"),
    )
    t = F.col("t_min")
    q = quantiles_of(
        rows, [key], {"all": F.when(reach, t), "served": F.when(reach & ~off, t)},
        {"t_median_all": ("all", 0.5), "t_median_served": ("served", 0.5), "t_p90_served": ("served", 0.9)},
    )
    return sums.join(q, key, "left").select(
        *sums.columns,
        *[rounded(F.col(c), 1).alias(c) for c in ("t_median_all", "t_median_served", "t_p90_served")],
    )


def scope_summary(points: DataFrame, facilities: DataFrame, key: str = "region") -> DataFrame:
    """Demand and supply per group, with the demand weight each usable facility carries."""
    w = F.col("weight")
    demand = points.groupBy(key).agg(
        F.countDistinct("district").alias("districts"), F.count("*").alias("points"),
        F.count_if(w == 0).alias("points_without_weight"), F.sum(w).alias("_w"),
        F.sum(F.when(F.col("is_urban"), w).otherwise(0.0)).alias("_u"),
        F.sum(F.when(~F.col("is_urban"), w).otherwise(0.0)).alias("_r"),
    )
    usable = F.col("resolutive") & F.col("routable")
    supply = facilities.groupBy(key).agg(
        F.count("*").alias("facilities"), F.count_if("coord_valid").alias("coord_valid"),
        F.count_if("resolutive").alias("resolutive"), F.count_if(usable).alias("resolutive_usable"),
    )
    counts = ["facilities", "coord_valid", "resolutive", "resolutive_usable"]
    return demand.join(supply, key, "left").select(
        key, "districts", "points", "points_without_weight",
        rounded(F.col("_w"), 0).alias("weight"), rounded(F.col("_u"), 0).alias("weight_urban"),
        rounded(F.col("_r"), 0).alias("weight_rural"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        rounded(F.col("_w") / F.nullif(F.col("resolutive_usable"), F.lit(0)), 0).alias("weight_per_usable"),
    )


def select_points(
    access: DataFrame, regions: list | None = None, districts: list | None = None,
    urban: bool | None = None,
) -> DataFrame:
    """Cascaded selection; an empty list or None keeps everything at that step."""
    out = access
    if regions:
        out = out.filter(F.col("region").isin(regions))
    if districts:
        out = out.filter(F.col("district").isin(districts))
    if urban is not None:
        out = out.filter(F.col("urban") == urban)
    return out


def district_options(access: DataFrame, regions: list) -> DataFrame:
    """Distinct choices that depend on a parent choice."""
    return access.filter(F.col("region").isin(regions) & F.col("district").isNotNull()).select(
        "region", "district"
    ).distinct().orderBy("region", "district")


def access_kpis(selection: DataFrame, limit_min: float = 60.0) -> DataFrame:
    """Weight within the limit, beyond it and without access, and the weighted median time."""
    none, w, t = no_access(), F.col("weight"), F.col("t_min")
    sums = selection.agg(
        F.sum(w).alias("weight"),
        F.sum(F.when(true(t <= limit_min) & ~none, w).otherwise(0.0)).alias("covered"),
        F.sum(F.when(none, w).otherwise(0.0)).alias("without_access"),
    )
    median = weighted_quantiles(
        selection.filter(~none), [], "t_min", "weight", {"median_min": 0.5}
    ).scalar()
    return sums.select(
        "weight", "covered", (F.col("weight") - F.col("covered") - F.col("without_access")).alias("beyond"),
        "without_access", median.alias("median_min"),
    )


def band_shares(selection: DataFrame) -> DataFrame:
    """Share of weight per band label; absent bands are 0."""
    band = time_band(F.col("t_min"), no_access())
    w = F.col("weight")
    rows = [
        F.struct(F.lit(b).alias("band"),
                 F.coalesce(F.try_divide(100 * F.sum(F.when(band == b, w).otherwise(0.0)), F.sum(w)), F.lit(0.0)).alias("pct"))
        for b in BAND_LABELS
    ]
    return selection.agg(F.array(*rows).alias("r")).select(F.inline("r"))


# ---------------------------------------------------------------- distributions
def empirical_cdf(access: DataFrame, key: str, value: str = "t_min") -> DataFrame:
    """Share of rows at or below each distinct value, per group."""
    rows = running_sums(access.filter(F.col(value).isNotNull()), [key], value, {"n": F.lit(1)})
    return rows.select(
        key, value, F.col("n").alias("rows"),
        ((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("cdf"),
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins of the clipped value; empty bins are 0."""
    v = F.greatest(F.least(F.col(value), F.lit(float(high))), F.lit(float(low)))
    counted = df.filter(F.col(value).isNotNull()).select(
        F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")
    ).groupBy("bin").agg(F.count("*").alias("rows"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return axis.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_from"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def histogram_with_median(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """:func:`histogram` and, on every row, the median of the values themselves (not clipped); NULL without values."""
    middle = quantiles(df, [], value, {"median": 0.5}).select(F.round("median", 6)).scalar()
    return histogram(df, value, low, high, bins).withColumn("median", middle)


def clipped_to_quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """Column ``out``: the value cut at its own quantile."""
    top = quantiles(df, [], value, {"_q": q}).scalar()
    return df.withColumn(out, F.least(F.col(value), top))


def heat_weight(points: DataFrame, q: float = 0.99) -> DataFrame:
    """min(weight / p99, 1) over the points with weight."""
    top = quantiles(points.filter(F.col("weight") > 0), [], "weight", {"_q": q}).scalar()
    return points.withColumn("heat", F.least(F.col("weight") / top, F.lit(1.0)))


def scale_ceilings(units: DataFrame, compared: DataFrame, points: DataFrame, ratio: str) -> DataFrame:
    """p95 of unit times, p98 of time ratios and p99 of point weights, one row."""
    a = quantiles(units, [], "t_mean", {"time_p95": 0.95})
    b = quantiles(compared, [], ratio, {"ratio_p98": 0.98}).scalar()
    c = quantiles(points, [], "weight", {"weight_p99": 0.99}).scalar()
    return a.select("time_p95", b.alias("ratio_p98"), c.alias("weight_p99"))


def facilities_by_category(facilities: DataFrame, categories: tuple[str, ...], key: str = "region") -> DataFrame:
    """Count per group and category, one column per category, absent combinations 0."""
    return facilities.groupBy(key).pivot("category", list(categories)).count().fillna(0)


def consolidate(access: DataFrame, attributes: DataFrame) -> DataFrame:
    """Bring point attributes back to an access table by its unique key."""
    return access.join(attributes, "point_id", "left")


# ---------------------------------------------------------------- scenarios
def upgrade_candidates(facilities: DataFrame) -> DataFrame:
    """Active, usable facilities one step below the capacity that is studied."""
    return facilities.filter(
        F.col("category").isin(*UPGRADABLE_CATEGORIES) & F.col("state").isin(*ACTIVE_STATES) & F.col("routable")
    )


def prune_candidate_pairs(candidate_pairs: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs that beat the current time of their origin, or serve an origin that reaches nothing."""
    now = current.select("point_id", F.col("t_min_s").alias("_now"), F.col("reachable").alias("_ok"))
    return candidate_pairs.join(now, "point_id", "left").filter(
        F.col("duration_s").isNotNull() & (~true("_ok") | true(F.col("duration_s") < F.col("_now")))
    ).drop("_now", "_ok")


def _after(better: Column) -> tuple[Column, Column]:
    """Time and no-access flag once ``better`` (minutes, may be NULL) becomes available."""
    t, none = F.col("t_min"), no_access()
    use = better.isNotNull() & (none | t.isNull() | (better < t))
    return F.when(use, better).otherwise(t), none & better.isNull()


def scenario_points(access: DataFrame, chosen_pairs: DataFrame) -> DataFrame:
    """Access table with the best time once every destination in ``chosen_pairs`` counts."""
    best = chosen_pairs.groupBy("point_id").agg((F.min("duration_s") / 60).alias("_new"))
    t_after, none_after = _after(F.col("_new"))
    return access.join(best, "point_id", "left").withColumns(
        {"t_after": t_after, "no_access_before": no_access(), "no_access_after": none_after}
    ).drop("_new")


def scenario_kpis(scenario: DataFrame, limit_min: float = 60.0) -> DataFrame:
    w, t, a = F.col("weight"), F.col("t_min"), F.col("t_after")
    before, after = F.col("no_access_before"), F.col("no_access_after")
    sums = scenario.agg(
        F.sum(F.when(true(t <= limit_min) & ~before, w).otherwise(0.0)).alias("covered_before"),
        F.sum(F.when(true(a <= limit_min) & ~after, w).otherwise(0.0)).alias("covered_after"),
        F.sum(F.when(after, w).otherwise(0.0)).alias("without_access_after"),
        F.count_if(true(a < F.coalesce(t, F.lit(float("inf"))))).alias("points_improved"),
    )
    median = weighted_quantiles(
        scenario.filter(~after), [], "t_after", "weight", {"median_after": 0.5}
    ).scalar()
    return sums.select("*", median.alias("median_after"))


def marginal_gains(access: DataFrame, candidate_pairs: DataFrame, limit_min: float = 60.0) -> DataFrame:
    """Weight newly within the limit for each candidate on its own, all candidates in one job.

    Only pairs within the limit can add coverage, so the others are dropped before the join.
    """
    near = (
        candidate_pairs.groupBy("facility_id", "point_id").agg((F.min("duration_s") / 60).alias("_new"))
        .filter(F.col("_new").isNotNull())
    )
    covered = true(F.col("t_min") <= limit_min) & ~no_access()
    t_after, none_after = _after(F.col("_new"))
    now = true(t_after <= limit_min) & ~none_after
    gain = F.when(now & ~covered, F.col("weight")).when(covered & ~now, -F.col("weight")).otherwise(0.0)
    return near.join(access, "point_id").groupBy("facility_id").agg(F.sum(gain).alias("gain"))


# ---------------------------------------------------------------- scope
def scope_is_stale(points: DataFrame, declared: list) -> DataFrame:
    """Regions present but not declared and declared but absent; stale when either is non-empty."""
    found = F.collect_set("region")
    wanted = F.array(*[F.lit(r) for r in declared])
    return points.agg(found.alias("f")).select(
        F.sort_array(F.array_except("f", wanted)).alias("undeclared"),
        F.sort_array(F.array_except(wanted, "f")).alias("missing"),
    ).withColumn("stale", (F.size("undeclared") > 0) | (F.size("missing") > 0))
