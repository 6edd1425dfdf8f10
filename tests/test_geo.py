"""Areas, nearest neighbours, ids and samples against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almenara.operators import geo, sampling

# A concave outline with a hole, and a square to its right.
HOOK = [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 4.0), (0.0, 4.0)], [(0.2, 0.2), (0.6, 0.2), (0.6, 0.6), (0.2, 0.6)]]
SQUARE = [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]]
RINGS = "area_id string, ordinal int, rings array<array<struct<lon:double,lat:double>>>"


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([("hook", 1, HOOK), ("square", 2, SQUARE)], RINGS).select(
        "area_id", "ordinal", geo.ring_edges(F.col("rings")).alias("edges"))


def test_points_in_concave_areas_with_holes(spark, areas):
    pts = [(1, 0.5, 2.0, "hook"), (2, 2.0, 2.0, None), (3, 0.4, 0.4, None), (4, 5.0, 2.0, "square"), (5, 2.0, 0.5, "hook"),
           (6, 4.0, 0.5, "square"), (7, 9.0, 9.0, None), (8, None, 1.0, None)]
    df = spark.createDataFrame([p[:3] for p in pts], "point_id long, lon double, lat double")
    for cell in (1.0, 0.3, 50.0):
        assert {r.point_id: r.area_id for r in geo.locate(df, areas, cell=cell).collect()} == {p[0]: p[3] for p in pts}


def test_overlapping_areas_give_the_first(spark, areas):
    both = areas.unionByName(areas.filter("area_id = 'square'").select(F.lit("later").alias("area_id"), F.lit(9).alias("ordinal"), "edges"))
    df = spark.createDataFrame([(1, 5.0, 2.0)], "point_id long, lon double, lat double")
    assert geo.locate(df, both).first().area_id == "square"


def test_declared_area_states(spark, areas):
    rows = [(1, 0.5, 2.0, "hook", True), (2, 5.0, 2.0, "hook", True), (3, 4.001, 3.5, "hook", True), (4, 9.0, 9.0, "hook", True),
            (5, 0.5, 2.0, "hook", False), (6, 8.001, 1.0, "square", True), (7, 0.5, 2.0, "unknown", True)]
    df = spark.createDataFrame(rows, "point_id long, lon double, lat double, declared string, coord_valid boolean")
    out = {r.point_id: r.area_state for r in geo.check_declared_area(df, areas, "declared").collect()}
    assert out == {1: "OK", 2: "CONFLICTO", 3: "OK_TOLERANCIA_BORDE", 4: "FUERA_DE_TODO_DISTRITO", 5: "NO_EVALUADO", 6: "OK_TOLERANCIA_BORDE", 7: "CONFLICTO"}


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_nearest_equals_brute_force_in_crowded_groups(spark, leaf):
    rng = np.random.default_rng(leaf)
    # A third of the targets share one place, a third crowd in a kilometre, the rest are spread out.
    tx = np.concatenate([np.full(60, 500.0), rng.normal(2e5, 300, 60), rng.uniform(-3e6, 3e6, 60)])
    ty = np.concatenate([np.full(60, 500.0), rng.normal(1e5, 300, 60), rng.uniform(-2e6, 2e6, 60)])
    tg = rng.integers(0, 2, 180)
    qx, qy = np.append(rng.uniform(-3e6, 3e6, 150), tx[100:130]), np.append(rng.uniform(-2e6, 2e6, 150), ty[100:130])
    qg = rng.integers(0, 3, 180)
    t = spark.createDataFrame([(int(i), int(g), float(x), float(y)) for i, (g, x, y) in enumerate(zip(tg, tx, ty))], "tid long, g int, x double, y double")
    q = spark.createDataFrame([(int(i), int(g), float(x), float(y)) for i, (g, x, y) in enumerate(zip(qg, qx, qy))], "qid long, g int, x double, y double")
    out = {r.qid: r for r in geo.nearest(q, t, "qid", "tid", ["x", "y"], ["g"], leaf_size=leaf).collect()}
    assert set(out) == {i for i in range(180) if qg[i] < 2}
    for i, r in out.items():
        m = np.flatnonzero(tg == qg[i])
        d = np.round((tx[m] - qx[i]) ** 2 + (ty[m] - qy[i]) ** 2, 3)
        assert r.target == m[np.lexsort((m, d))][0]
        assert r.distance == pytest.approx(math.sqrt(d.min()), abs=1e-3)


def test_nearest_ranks_no_rows_and_finds_places_once(spark, capsys):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(-1e6, 1e6, (2, 3000))
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "tid long, x double, y double")
    at = rng.uniform(-1.2e6, 1.2e6, (500, 2))
    odd = [(-1, None, 0.0), (-2, math.nan, 0.0), (-3, math.inf, 0.0)]
    q = spark.createDataFrame([(i, float(at[i % 500, 0]), float(at[i % 500, 1])) for i in range(5000)] + odd, "qid long, x double, y double")
    out = geo.nearest(q, t, "qid", "tid", ["x", "y"], [])
    out.explain()
    assert "Window" not in capsys.readouterr().out  # single queries were ranked among all cells open to them on each level
    d = np.round((x[None] - at[:, :1]) ** 2 + (y[None] - at[:, 1:]) ** 2, 3)
    assert {r.qid: r.target for r in out.collect()} == {i: int(d[i % 500].argmin()) for i in range(5000)}


def test_imputation_conserves_district_totals(spark):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(int(i), int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, -70, 40), rng.uniform(-15, -5, 40)))], "point_id long, district int, lon double, lat double")
    cells = spark.createDataFrame([(int(i), int(i % 4), float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.uniform(-80, -70, 300), rng.uniform(-15, -5, 300), rng.uniform(-1, 9, 300)))], "cell_id long, district int, lon double, lat double, value double")
    out = geo.impute_weights(pts, cells)
    assert out.count() == 40
    assert all(r.conserved for r in geo.conservation(out, cells).collect())


def test_snapping_by_great_circle(spark):
    nodes = [(1, -77.03, -12.05), (2, 179.9, 10.0), (3, 0.0, 89.5)]
    pts = [(1, -77.0, -12.0, 1), (2, -179.9, 10.0, 2), (3, 120.0, 89.9, 3)]
    n = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    p = spark.createDataFrame([x[:3] for x in pts] + [(4, None, 1.0)], "point_id long, lon double, lat double")
    out = {r.point_id: r for r in geo.snap_to_network(p, n, max_m=100_000).collect()}
    assert [out[x[0]].node_id for x in pts] == [x[3] for x in pts]
    a, b = math.radians(-12.05), math.radians(-12.0)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(0.03) / 2) ** 2
    assert out[1].snap_m == pytest.approx(2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h)), abs=0.01)
    assert (out[4].snap_ok, out[4].snap_m) == (False, None)
    assert not {r.point_id: r for r in geo.snap_to_network(p, n, max_m=1000).collect()}[1].snap_ok


def test_sequential_ids_follow_one_global_order(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), int(rng.integers(0, 4)), float(np.round(rng.normal(-77, 1), 1)), float(np.round(rng.normal(-12, 1), 1))) for i in range(500)]
    df = spark.createDataFrame(data, "point_id long, district int, lon double, lat double")
    out = {r.point_id: r.place_id for r in geo.sequential_ids(df, "district", "lon", ["lat", "point_id"]).collect()}
    ordered = sorted(data, key=lambda r: (r[1], r[2], r[3], r[0]))
    assert out == {r[0]: f"CP{i:06d}" for i, r in enumerate(ordered, 1)}


def round_robin(available, weight, cap):
    """The allocation one seat at a time, as a check of the closed form."""
    names = sorted(available)
    total = sum(weight.values())
    budget = cap - len(names)
    exact = {u: budget * weight[u] / total if total else 0.0 for u in names}
    seats = {u: min(int(exact[u]), available[u] - 1) for u in names}
    left = budget - sum(seats.values())
    order = sorted(names, key=lambda u: (-(exact[u] - int(exact[u])), u))
    while left > 0 and any(seats[u] < available[u] - 1 for u in names):
        for u in order:
            if left and seats[u] < available[u] - 1:
                seats[u] += 1
                left -= 1
    return {u: 1 + seats[u] for u in names}


@pytest.mark.parametrize("cap", [6, 20, 57, 500])
def test_quotas_equal_seat_by_seat_allocation(spark, cap):
    rng = np.random.default_rng(cap)
    data = [(i, int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])), float(rng.integers(0, 100))) for i in range(120)]
    df = spark.createDataFrame(data, "point_id long, district int, weight double")
    available, weight = {}, {}
    for _, d, w in data:
        available[d], weight[d] = available.get(d, 0) + 1, weight.get(d, 0.0) + w
    out = {r.district: r.quota for r in sampling.quotas(df, cap).collect()}
    assert out == round_robin(available, weight, cap)
    drawn = sampling.draw_sample(df, cap)
    got = {r.district: r["n"] for r in drawn.groupBy("district").agg(F.count("*").alias("n")).collect()}
    assert got == out
    heaviest = {d: max((w, -i) for i, e, w in data if e == d)[1] for d in available}
    assert {-i for i in heaviest.values()} <= {r.point_id for r in drawn.collect()}
    sums = {r.district: r.s for r in sampling.expansion_weights(drawn, df).groupBy("district").agg(F.sum("sample_weight").alias("s")).collect()}
    assert sums == pytest.approx(weight)


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(400).select(F.col("id").alias("point_id"), (F.col("id") % 5).alias("district"), (F.col("id") % 13).cast("double").alias("weight"))
    a = {r.point_id for r in sampling.draw_sample(df.repartition(7), 50).collect()}
    b = {r.point_id for r in sampling.draw_sample(df.coalesce(1), 50).collect()}
    assert a == b and len(a) == 50


def test_a_cap_below_the_number_of_strata_stops_the_job(spark):
    df = spark.range(10).select(F.col("id").alias("point_id"), F.col("id").alias("district"), F.lit(1.0).alias("weight"))
    with pytest.raises(Exception, match="cannot give every stratum"):
        sampling.quotas(df, 5).collect()


def test_strata_without_weight_are_split_evenly(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0), (3, 1, 5.0)], "point_id long, district int, weight double")
    out = {r.point_id: r.sample_weight for r in sampling.expansion_weights(df, df).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 5.0}


def test_a_point_inside_its_declared_area_is_accepted_where_areas_overlap(spark, areas):
    both = areas.unionByName(areas.filter("area_id = 'square'").select(F.lit("later").alias("area_id"), F.lit(9).alias("ordinal"), "edges"))
    df = spark.createDataFrame([(1, 6.0, 2.0, "later", True), (2, 6.0, 2.0, "hook", True)], "point_id long, lon double, lat double, declared string, coord_valid boolean")
    out = {r.point_id: (r.real_area, r.area_state) for r in geo.check_declared_area(df, both, "declared").collect()}
    assert out == {1: ("square", "OK_TOLERANCIA_BORDE"), 2: ("square", "CONFLICTO")}


def test_unusable_cells_count_on_neither_side(spark):
    points = spark.createDataFrame([(1, "d", 5.0)], "point_id long, district string, imputed double")
    cells = spark.createDataFrame([("d", 5.0), ("d", float("nan")), ("d", float("inf")), ("d", -1.0)], "district string, value double")
    assert [(r.total_in, r.total_out, r.conserved) for r in geo.conservation(points, cells).collect()] == [(5.0, 5.0, True)]


def star(cx, cy, size, n, rng):
    """A jagged ring around a centre."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + size * rng.uniform(0.2, 1) * math.cos(t), cy + size * rng.uniform(0.2, 1) * math.sin(t)) for t in turns]


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def outline_distance(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy or 1)))
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.fixture(scope="module")
def jagged(spark):
    rng = random.Random(3)
    shapes = [[star(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.3, 2.5), rng.randint(3, 40), rng)] for _ in range(12)]
    shapes.append([star(0.5, 0.5, 3.5, 60, rng), star(0.5, 0.5, 0.6, 9, rng)])
    rows = [(i, i, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    areas = spark.createDataFrame(rows, "area_id int, ordinal int, rings array<array<struct<lon:double,lat:double>>>")
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4), i % 13) for i in range(600)] + [(1000 + i, 0.25, -0.25, 12) for i in range(900)]
    points += [(3000 + i, float(i % 5 - 2), float(i // 5 - 2), 12) for i in range(25)] + [(4000, None, 1.0, 1), (4001, 1.0, None, 1)]
    df = spark.createDataFrame([(*p, True) for p in points], "point_id int, lon double, lat double, said int, coord_valid boolean")
    return shapes, areas.withColumn("edges", geo.ring_edges(F.col("rings"))), points, df


@pytest.mark.parametrize("cell, crowd", [(1.0, 1_000_000), (0.3, 50), (7.0, 100)])
def test_covered_areas_equal_the_even_odd_rule(jagged, cell, crowd):
    shapes, areas, points, df = jagged
    got = {r.point_id: r.area_id for r in geo.locate(df, areas, cell=cell, crowd=crowd).collect()}
    for i, x, y, _ in points:
        want = next((a for a, rings in enumerate(shapes) if even_odd(rings, x, y)), None) if None not in (x, y) else None
        assert got[i] == want


def test_declared_areas_by_cells_equal_the_whole_outline(jagged):
    shapes, areas, points, df = jagged
    got = {r.point_id: r.area_state for r in geo.check_declared_area(df, areas, "said", tolerance=0.05, crowd=40).collect()}
    for i, x, y, said in points:
        if None in (x, y):
            continue
        real = next((a for a, rings in enumerate(shapes) if even_odd(rings, x, y)), None)
        near = real != said and (even_odd(shapes[said], x, y) or outline_distance(shapes[said], x, y) <= 0.05)
        assert got[i] == ("OK" if real == said else "OK_TOLERANCIA_BORDE" if near else "FUERA_DE_TODO_DISTRITO" if real is None else "CONFLICTO")


def test_most_leaves_of_a_large_area_need_no_outline(spark):
    ring = [[{"lon": x, "lat": y} for x, y in ((0.1, 0.1), (9.9, 0.1), (9.9, 9.9), (0.1, 9.9))]]
    areas = spark.createDataFrame([(1, 1, ring)], "area_id int, ordinal int, rings array<array<struct<lon:double,lat:double>>>").withColumn("edges", geo.ring_edges(F.col("rings")))
    leaves = geo.cover(areas, 1.0).select(F.inline("leaves"))
    inner = leaves.filter("inner").agg(F.sum(F.col("side") * F.col("side"))).first()[0]
    border = leaves.filter("not inner").agg(F.sum(F.col("side") * F.col("side")), F.max(F.size("near"))).first()
    assert inner >= 64 + 4 * 8 * 0.5 and border[0] <= 9.8 * 9.8 - 64 and border[1] <= 2


def test_a_crowded_cell_is_read_by_many_tasks(spark, jagged):
    _, areas, points, df = jagged
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "24")):
            spark.conf.set(k, v)
        placed, keys = geo._placed(df, 1.0, "point_id"), ["_cx", "_cy"]
        met = geo.meet_in_cells(placed, geo.cover(areas, 1.0), "point_id", keys, geo.crowded(placed, keys, 40))
        here = met.filter((F.col("lon") == 0.25) & (F.col("lat") == -0.25))
        tasks = here.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("point_id").alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tasks) >= 8 and sum(r.n for r in tasks) == 900 and max(r.n for r in tasks) < 300


@pytest.mark.parametrize("cap", [7, 5000, 11000])
def test_draws_beyond_a_thousand_equal_ranking_all_keys(spark, cap):
    """The default cap on a hot stratum with many equal weights, against a ranking of every draw key."""
    rows = spark.range(9000).select(
        F.col("id").alias("point_id"), F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 5).cast("int").alias("district"),
        F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 5.0).otherwise((F.col("id") % 97) * 1e6).alias("weight"), F.lit("x").alias("extra"))
    drawn = sampling.draw_sample(rows, cap)
    assert drawn.columns == rows.columns
    got = {r.point_id for r in drawn.collect()}
    quota = {r.district: r.quota for r in sampling.quotas(rows, cap).collect()}
    keys = rows.withColumn("k", F.round(sampling.draw_key("point_id", "weight", sampling.ACCESS.seed), 12)).collect()
    want = set()
    for d, q in quota.items():
        own = [r for r in keys if r.district == d]
        forced = max(own, key=lambda r: (r.weight, -r.point_id)).point_id
        order = sorted((r for r in own if r.point_id != forced), key=lambda r: (-r.k, r.point_id))
        want |= {forced, *(r.point_id for r in order[: q - 1])}
    assert got == want and drawn.count() == len(got)
