"""Access metrics on small hand-computed tables."""

import pytest
from pyspark.sql import functions as F

from almenara.operators import access as ops
from almenara.operators import games, inequality, series

ACCESS = "point_id long, region int, district int, weight double, t_min double, reachable boolean, off_network boolean, urban boolean"


@pytest.fixture(scope="module")
def access(spark):
    return spark.createDataFrame([
        (1, 0, 1, 100.0, 30.0, True, False, True), (2, 0, 1, 50.0, 60.0, True, False, False),
        (3, 0, 2, 25.0, 120.0, True, False, True), (4, 0, 2, 25.0, 120.5, True, False, True),
        (5, 1, 3, 40.0, 10.0, True, True, True), (6, 1, 3, 60.0, None, False, False, False),
        (7, None, 4, 10.0, 5.0, True, None, None),
    ], ACCESS)


def test_bands_are_closed_above_and_keep_no_access_apart(access):
    out = {r.group_name: r for r in ops.coverage_bands(access).collect()}
    assert set(out) == {"0", "1", "TOTAL"}
    a = out["0"]
    assert (a.weight_0_30, a.weight_30_60, a.weight_60_120, a.weight_over_120, a.weight_no_access) == (100, 50, 25, 25, 0)
    assert (a.pct_within_30, a.pct_within_60, a.pct_within_120) == (50.0, 75.0, 87.5)
    assert (out["1"].weight_no_access, out["1"].pct_no_access) == (100, 100.0)
    assert out["TOTAL"].weight_total == 310


def test_levels_keep_null_keys_and_rank_gaps(access):
    levels = ops.aggregate_by_level(access, {"district": ["region", "district"], "region": ["region"]})
    by = {(r.level, r.region, r.district): r for r in levels.collect()}
    assert by["region", None, None].points == 1
    assert by["district", 1, 3].t_mean is None and by["district", 1, 3].pct_without_access == 100.0
    assert by["district", 0, 1].t_mean == 40.0
    gaps = ops.critical_gaps(levels.filter("level = 'district'"), 3).orderBy("ranking").collect()
    assert [(r.ranking, r.district) for r in gaps] == [(1, 3), (2, 2), (3, 1)]
    assert gaps[0].weight_without_access == 100.0


def test_a_unit_without_weight_sorts_before_slow_units(spark):
    units = spark.createDataFrame([(0, 1, 0.0, 0.0, None), (0, 2, 5.0, 0.0, 99.0), (0, 3, 5.0, 50.0, 1.0)],
                                  "region int, district int, weight double, pct_without_access double, t_mean double")
    assert [r.district for r in ops.critical_gaps(units).orderBy("ranking").collect()] == [3, 1, 2]
    assert ops.worst_unit(units).first().district == 3


def test_nearest_keeps_unreachable_origins_and_breaks_ties_by_id(spark):
    pairs = spark.createDataFrame(
        [(1, 9, 60.0, 5.0), (1, 4, 60.0, 7.0), (1, 2, 90.0, 1.0), (2, 4, None, None), (3, 4, 0.0, 0.0)],
        "point_id long, facility_id long, duration_s double, distance_m double")
    out = {r.point_id: r for r in ops.nearest_destination(pairs).collect()}
    assert (out[1].nearest_id, out[1].dist_min_m, out[1].t_min_min, out[1].collapsed_trip) == (4, 7.0, 1.0, False)
    assert (out[2].reachable, out[2].nearest_id) == (False, None)
    assert out[3].collapsed_trip


def test_changed_nearest_is_unknown_where_a_mode_reaches_nothing(spark):
    near = spark.createDataFrame(
        [(1, 1, 5, 10.0, 1.0, True), (1, 2, 6, 30.0, 1.0, True), (2, 1, 5, 0.0, 1.0, True), (2, 2, 5, 30.0, 1.0, True), (3, 1, 5, 9.0, 1.0, True)],
        "point_id long, mode int, nearest_id int, t_min_min double, dist_min_m double, reachable boolean")
    demand = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "point_id long, region int")
    compared = ops.compare_modes(near, demand, {1: "car", 2: "foot"}, 1)
    out = {r.point_id: r for r in compared.collect()}
    assert [out[i].changed_foot for i in (1, 2, 3)] == [True, False, None]
    assert [out[i].ratio_foot for i in (1, 2, 3)] == [3.0, None, None]
    s = ops.mode_summary(compared, {1: "car", 2: "foot"}, 1).first()
    assert (s.points, s.reachable_foot, s.pct_changed_foot, s.ratio_median_foot) == (3, 2, 50.0, 3.0)


def test_pairs_that_are_absent_count_as_unreachable(spark):
    o = spark.createDataFrame([(1,), (2,)], "point_id long")
    d = spark.createDataFrame([(7,), (8,), (9,)], "facility_id long")
    p = spark.createDataFrame([(1, 7, 5.0), (1, 8, None), (1, 99, 4.0)], "point_id long, facility_id long, duration_s double")
    out = {r.point_id: tuple(r)[1:] for r in ops.pair_completeness(o, d, p).collect()}
    assert out == {1: (3, 1, 2), 2: (3, 0, 3)}


def test_scenario_and_marginal_gains_overlap(spark, access):
    pairs = spark.createDataFrame([(2, 70, 1200.0), (2, 71, 1500.0), (6, 70, 600.0), (3, 71, 3600.0), (1, 71, 60.0)],
                                  "point_id long, facility_id long, duration_s double")
    k = ops.scenario_kpis(ops.scenario_points(access, pairs), 30.0).first()
    assert (k.covered_before, k.covered_after, k.without_access_after) == (110.0, 220.0, 40.0)
    assert k.points_improved == 4
    gains = {r.facility_id: r.gain for r in ops.marginal_gains(access, pairs, 30.0).collect()}
    assert gains == {70: 110.0, 71: 50.0}
    assert sum(gains.values()) != k.covered_after - k.covered_before


def test_pruning_keeps_pairs_that_can_matter(spark):
    now = spark.createDataFrame([(1, 100.0, True), (2, None, False)], "point_id long, t_min_s double, reachable boolean")
    p = spark.createDataFrame([(1, 5, 99.0), (1, 6, 100.0), (2, 5, 9e9), (2, 6, None), (3, 5, 1.0)], "point_id long, facility_id long, duration_s double")
    kept = {(r.point_id, r.facility_id) for r in ops.prune_candidate_pairs(p, now).collect()}
    assert kept == {(1, 5), (2, 5), (3, 5)}


def test_network_threshold_and_missing_snaps(spark):
    demand = spark.createDataFrame([(i, 0, 10.0) for i in range(1, 6)], "point_id long, region int, weight double")
    snap = spark.createDataFrame([(1, 2000.0, True), (2, 2000.1, True), (3, None, False), (4, None, True)], "point_id long, snap_m double, snap_ok boolean")
    covered = ops.classify_network_coverage(demand, snap)
    assert {r.point_id: r.off_network for r in covered.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    sweep = ops.snap_sensitivity(covered, (500, 5000), (0,)).orderBy("threshold_m").collect()
    assert [(r.points_off, r.pct_weight, r.pct_weight_0) for r in sweep] == [(4, 80.0, 80.0), (2, 40.0, 40.0)]


def test_selections_and_bands(access):
    picked = ops.select_points(access, regions=[0], urban=True)
    shares = {r.band: r.pct for r in ops.band_shares(picked).collect()}
    assert len(shares) == 5 and shares["≤30 min"] == pytest.approx(100 / 150 * 100) and shares["Sin acceso vial"] == 0.0
    k = ops.access_kpis(ops.select_points(access, regions=[0, 1])).first()
    assert (k.weight, k.covered, k.beyond, k.without_access) == (300.0, 150.0, 50.0, 100.0)


def test_histogram_clips_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (299.0,), (5000.0,), (None,)], "t double")
    out = {r.bin: r.rows for r in ops.histogram(df, "t", 0, 300, 40).collect()}
    assert len(out) == 40 and out[0] == 1 and out[39] == 2 and sum(out.values()) == 3


def test_quadrants_use_strict_medians(spark):
    units = spark.createDataFrame([(0, f"{i:06d}", 1.0, t) for i, t in enumerate([1.0, 2.0, 3.0, None])], "region int, ubigeo string, weight double, t_mean double")
    poverty = spark.createDataFrame([("000000", 10.0), ("000001", 20.0), ("000002", 30.0), ("000003", 5.0)], "ubigeo string, poverty_rate double")
    out = {r.ubigeo: r.quadrant for r in inequality.join_poverty(units, poverty).collect()}
    assert out["000002"] == inequality.QUADRANTS[0] and out["000001"] == inequality.QUADRANTS[3]
    assert out["000003"] == inequality.NO_DATA


def test_scope_staleness(access):
    r = ops.scope_is_stale(access.filter("region is not null"), [0, 2]).first()
    assert (r.undeclared, r.missing, r.stale) == ([1], [2], True)
    assert not ops.scope_is_stale(access.filter("region is not null"), [1, 0]).first().stale


def test_game_tables(spark):
    """100 games with the published marginals of every table."""
    wins = ["mate"] * 20 + ["resign"] * 45 + ["outoftime"] * 7
    losses = ["mate"] * 1 + ["resign"] * 13 + ["outoftime"] * 6
    draws = ["draw"] * 7 + ["outoftime"]
    rows = [(e, r) for r, es in (("win", wins), ("loss", losses), ("draw", draws)) for e in es]
    colour = ["black"] * 38 + ["white"] * 34 + ["black"] * 12 + ["white"] * 16
    data = [(i, i, "blitz" if i < 2 else "bullet", c, 3000 + i, r, e) for i, ((e, r), c) in enumerate(zip(rows, colour))]
    g = spark.createDataFrame(data, "game_id int, ts int, mode string, colour string, rating int, result string, ending string")
    assert {tuple(r) for r in games.result_shares(g).collect()} == {("win", 72, 72.0), ("loss", 20, 20.0), ("draw", 8, 8.0)}
    assert {tuple(r) for r in games.wins_by(g, "colour").collect()} == {("black", 50, 38, 76.0), ("white", 50, 34, 68.0)}
    assert {tuple(r) for r in games.wins_by(g, "mode").collect()} == {("blitz", 2, 2, 100.0), ("bullet", 98, 70, 71.4)}
    assert {tuple(r) for r in games.endings(g).collect()} == {
        ("Jaque mate", 1, 20, 20.0, 1.0), ("Rendicion", 13, 45, 45.0, 13.0), ("Tiempo", 6, 7, 7.0, 6.0)}
    assert tuple(games.rating_summary(g).first()) == (3000, 3099, 3000, 3099, 3049.5)


def test_carry_forward(spark):
    q = spark.createDataFrame([("usd", "2024-06-01", 3.7), ("usd", "2024-06-04", 3.8), ("eur", "2024-06-02", 4.0)], "c string, s string, buy double")
    q = q.select("c", F.to_date("s").alias("d"), "buy")
    out = series.daily_carry_forward(q, "c", "d", ["buy"], start="2024-06-01", end="2024-06-05")
    usd = [(r.d.day, r.buy, r.origin, r.value_day.day) for r in out.filter("c = 'usd'").orderBy("d").collect()]
    assert usd == [(1, 3.7, "publicado", 1), (2, 3.7, "arrastrado", 1), (3, 3.7, "arrastrado", 1), (4, 3.8, "publicado", 4), (5, 3.8, "arrastrado", 4)]
    summary = {r.c: tuple(r)[1:] for r in series.series_summary(out, "c").collect()}
    assert summary == {"usd": (5, 2, 3, 0), "eur": (5, 1, 3, 1)}


def test_histogram_counts_values_below_its_axis(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (999.0,)], "t double")
    assert [r.rows for r in ops.histogram(df, "t", 0, 300, 3).orderBy("bin").collect()] == [2, 0, 1]


def test_bands_follow_their_edges(spark):
    from pyspark.sql import functions as F

    from almenara.settings import ACCESS

    df = spark.createDataFrame([(10.0,), (45.0,)], "t double")
    default = [r.b for r in df.select(ops.time_band(F.col("t"), F.lit(False)).alias("b")).collect()]
    moved = [r.b for r in df.select(ops.time_band(F.col("t"), F.lit(False), (50, 60, 120)).alias("b")).collect()]
    assert ACCESS.bands_min == (30, 60, 120) and default[0] != default[1] and moved == [default[0]] * 2


def test_histogram_with_the_median_of_unclipped_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 9.0, 500.0, None)], "t double")
    rows = ops.histogram_with_median(df, "t", 0, 10, 5).collect()
    assert [r["rows"] for r in sorted(rows, key=lambda r: r.bin)] == [1, 1, 0, 0, 2] and {r["median"] for r in rows} == {5.5}
    assert {r["median"] for r in ops.histogram_with_median(df.filter("t is null"), "t", 0, 10, 5).collect()} == {None}
