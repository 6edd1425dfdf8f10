"""Queries on places, areas, nearest neighbours and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.operators import geo as ops
from almenara.operators import sampling
from almenara.plans.registry import query

_PLACES = """pl AS (SELECT point_id, district, lon + (point_id % 7) * CAST(0.00037 AS DOUBLE) AS lon,
  lat + (point_id % 5) * CAST(0.00053 AS DOUBLE) AS lat, point_id % 31 <> 0 AS coord_valid FROM points)"""


def _places(t):
    i = F.col("point_id")
    return t.points.select(
        "point_id", "district", (F.col("lon") + (i % 7) * 0.00037).alias("lon"),
        (F.col("lat") + (i % 5) * 0.00053).alias("lat"), (i % 31 != 0).alias("coord_valid"),
    )


def _areas(t):
    rings = ops.rectangle_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return t.geo.select(
        F.col("district").alias("area_id"), F.col("district").alias("ordinal"), ops.ring_edges(rings).alias("edges")
    )


@query("point_in_area", ("points", "geo"), f""", {_PLACES}
SELECT p.point_id, min(g.district) AS area_id FROM pl p LEFT JOIN geo g ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY 1""")
def _point_in_area(t):
    return ops.locate(_places(t), _areas(t)).select("point_id", "area_id")


_STATES = f"""{_PLACES},
r AS (SELECT p.point_id, min(g.district) AS real_area FROM pl p LEFT JOIN geo g ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 WHERE coord_valid GROUP BY 1),
j AS (SELECT p.*, r.real_area, sqrt(pow(greatest(g.x0 - lon, 0, lon - g.x1), 2) + pow(greatest(g.y0 - lat, 0, lat - g.y1), 2)) AS dist
  FROM pl p LEFT JOIN r ON p.point_id = r.point_id LEFT JOIN geo g ON g.district = p.district),
sa AS (SELECT point_id, real_area, CASE WHEN NOT coord_valid THEN 'NO_EVALUADO' WHEN real_area = district THEN 'OK'
  WHEN dist <= 0.002 THEN 'OK_TOLERANCIA_BORDE' WHEN real_area IS NULL THEN 'FUERA_DE_TODO_DISTRITO' ELSE 'CONFLICTO' END AS area_state FROM j)"""


@query("declared_area_check", ("points", "geo"), f", {_STATES} SELECT * FROM sa")
def _declared(t):
    return ops.check_declared_area(_places(t), _areas(t), "district").select("point_id", "real_area", "area_state")


@query("declared_area_summary", ("points", "geo"), f", {_STATES} SELECT area_state, count(*) AS rows FROM sa GROUP BY 1")
def _declared_summary(t):
    checked = ops.check_declared_area(_places(t), _areas(t), "district")
    return checked.groupBy("area_state").agg(F.count("*").alias("rows"))


_PLANE = """rf AS (SELECT district, round(avg(lat), 9) AS ref FROM points GROUP BY district),
pp AS (SELECT point_id, p.district, lon * 111320 * cos(radians(ref)) AS x, lat * 110540 AS y FROM points p JOIN rf ON p.district = rf.district),
cc AS (SELECT cell_id, value, c.district, lon * 111320 * cos(radians(ref)) AS x, lat * 110540 AS y FROM cells c JOIN rf ON c.district = rf.district WHERE value > 0),
ow AS (SELECT cell_id, any_value(value) AS value, arg_min(point_id, {'d': round((cc.x - pp.x) * (cc.x - pp.x) + (cc.y - pp.y) * (cc.y - pp.y), 3), 'i': point_id}) AS owner
  FROM cc JOIN pp ON cc.district = pp.district GROUP BY cell_id),
im AS (SELECT owner, sum(value) AS imputed FROM ow GROUP BY owner)"""


@query("imputed_weights", ("points", "cells"), f""", {_PLANE}
SELECT p.point_id, round(coalesce(imputed, 0), 2) AS imputed, coalesce(imputed, 0) > 0 AS has_cells
FROM points p LEFT JOIN im ON im.owner = p.point_id""")
def _imputed(t):
    return ops.impute_weights(t.points, t.cells).select("point_id", F.round("imputed", 2).alias("imputed"), "has_cells")


@query("imputation_conservation", ("points", "cells"), """SELECT p.district, round(coalesce(v, 0), 2) AS total_in, round(coalesce(v, 0), 2) AS total_out, true AS conserved
FROM (SELECT DISTINCT district FROM points) p LEFT JOIN (SELECT district, sum(value) AS v FROM cells WHERE value > 0 GROUP BY 1) c ON p.district = c.district""")
def _conservation(t):
    out = ops.conservation(ops.impute_weights(t.points, t.cells), t.cells)
    return out.select("district", F.round("total_in", 2).alias("total_in"), F.round("total_out", 2).alias("total_out"), "conserved")


@query("local_plane", ("points",), """, rf AS (SELECT district, round(avg(lat), 9) AS ref FROM points GROUP BY district)
SELECT point_id, round(lon * 111320 * cos(radians(ref)), 3) AS x, round(lat * 110540, 3) AS y FROM points p JOIN rf ON p.district = rf.district""")
def _plane(t):
    ref = t.points.groupBy("district").agg(F.round(F.avg("lat"), 9).alias("ref"))
    x, y = ops.plane_metres(F.col("lon"), F.col("lat"), F.col("ref"))
    return t.points.join(ref, "district").select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("network_snapping", ("points", "cells"), """SELECT c.cell_id, min_by(snap_m, snap_m) AS snap_m, true AS snap_ok FROM (
SELECT cell_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2)
  + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))), 2) AS snap_m FROM cells c, points p) c GROUP BY cell_id""")
def _snapping(t):
    nodes = t.points.select(F.col("point_id").alias("node_id"), "lon", "lat")
    out = ops.snap_to_network(t.cells, nodes, key="cell_id")
    return out.select("cell_id", F.round("snap_m", 2).alias("snap_m"), "snap_ok")


@query("sequential_place_ids", ("points",), """SELECT point_id, printf('CP%06d', row_number() OVER (ORDER BY district, lon, lat, point_id)) AS place_id FROM points""")
def _sequential(t):
    return ops.sequential_ids(t.points, "district", "lon", ["lat", "point_id"]).select("point_id", "place_id")


_CAP = 300
_QUOTA = f"""qs AS (SELECT district, count(*) AS available, sum(weight) AS w FROM points GROUP BY district),
qx AS (SELECT *, {_CAP} - count(*) OVER () AS budget, ({_CAP} - count(*) OVER ()) * w / sum(w) OVER () AS exact FROM qs),
qe AS (SELECT *, least(floor(exact), available - 1) AS extra, exact - floor(exact) AS rest FROM qx),
qn AS (SELECT *, budget - sum(extra) OVER () AS leftover FROM qe),
sl AS (SELECT district, s, rest, leftover, row_number() OVER (ORDER BY s, rest DESC, district) AS seat
  FROM (SELECT *, unnest(range(1, CAST(available - 1 - extra AS BIGINT) + 1)) AS s FROM qn) z),
qm AS (SELECT district, count(*) AS more FROM sl WHERE seat <= leftover GROUP BY district),
qt AS (SELECT qn.district, available, CAST(1 + extra + coalesce(more, 0) AS BIGINT) AS quota FROM qn LEFT JOIN qm ON qn.district = qm.district)"""
_DRAW = f"""{_QUOTA},
kd AS (SELECT p.*, round(ln((CAST(concat('0x', substr(md5(concat_ws('|', CAST(point_id AS VARCHAR), '42')), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0) / greatest(weight, 1e-9), 12) AS k,
  row_number() OVER (PARTITION BY district ORDER BY weight DESC, point_id) = 1 AS forced FROM points p),
rn AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY forced DESC, k DESC, point_id) AS r FROM kd),
dr AS (SELECT rn.point_id, rn.district, rn.weight FROM rn JOIN qt ON rn.district = qt.district WHERE r <= quota)"""


@query("sample_quotas", ("points",), f", {_QUOTA} SELECT * FROM qt")
def _quotas(t):
    return sampling.quotas(t.points, _CAP)


@query("weighted_sample", ("points",), f", {_DRAW} SELECT * FROM dr")
def _sample(t):
    return sampling.draw_sample(t.points, _CAP).select("point_id", "district", "weight")


@query("sample_expansion_weights", ("points",), f""", {_DRAW}, tt AS (SELECT district, sum(weight) AS total FROM points GROUP BY 1)
SELECT point_id, dr.district, round(CASE WHEN sum(dr.weight) OVER (PARTITION BY dr.district) = 0 THEN total / count(*) OVER (PARTITION BY dr.district)
  ELSE dr.weight * total / sum(dr.weight) OVER (PARTITION BY dr.district) END, 4) AS sample_weight FROM dr JOIN tt ON dr.district = tt.district""")
def _expansion(t):
    out = sampling.expansion_weights(sampling.draw_sample(t.points, _CAP), t.points)
    return out.select("point_id", "district", F.round("sample_weight", 4).alias("sample_weight"))
