"""Domain tables derived from the driver's parquet tables, one SQL text per table.

The same text runs on Spark and on DuckDB. Every derived table grows linearly with its inputs:
travel pairs are the (customer, supplier) pairs that occur in the order lines, a sparse table in
which a pair that is absent, or has a NULL duration, is unreachable.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almenara.session import prepare

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SHARED_SQL = {
    "points": """
SELECT c_custkey AS point_id, c_nationkey AS district, n_regionkey AS region,
  CAST(-81.4 AS DOUBLE) + CAST((c_custkey * 37) % 1280 AS DOUBLE) / 100 AS lon,
  CAST(-18.4 AS DOUBLE) + CAST((c_custkey * 53) % 1836 AS DOUBLE) / 100 AS lat,
  greatest(c_acctbal, CAST(0 AS DOUBLE)) AS weight,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'villa' ELSE NULL END AS category
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "facilities": """
SELECT s_suppkey AS facility_id, s_nationkey AS district, n_regionkey AS region, ord,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN '-77.03'
       WHEN s_suppkey % 10 = 2 THEN '0' WHEN s_suppkey % 10 = 3 THEN '45.5'
       WHEN s_suppkey % 10 = 4 THEN 'n/a' ELSE '-12.05' END AS lat_raw,
  CASE WHEN s_suppkey % 10 = 1 THEN '-12.05' ELSE '-77.03' END AS lon_raw,
  CASE s_suppkey % 6 WHEN 0 THEN 'II-1' WHEN 1 THEN ' ii - 2' WHEN 2 THEN 'III1' WHEN 3 THEN '0'
       WHEN 4 THEN 'i.3' ELSE 'I-4' END AS category_raw,
  CASE WHEN s_suppkey % 7 = 0 THEN ' cierre   temporal ' ELSE 'activo' END AS state_raw
FROM (SELECT s_suppkey, s_nationkey, 1 AS ord FROM supplier
      UNION ALL SELECT s_suppkey, s_nationkey, 2 AS ord FROM supplier WHERE s_suppkey % 25 = 0) s
JOIN nation ON s_nationkey = n_nationkey""",
    "pairs": """
SELECT point_id, facility_id, mode, min(t) AS duration_s, min(t) * 11 AS distance_m,
  facility_id % 4 = 0 AS resolutive, facility_id % 4 = 1 AS proposed
FROM (SELECT o_custkey AS point_id, l_suppkey AS facility_id, 1 + l_linenumber % 3 AS mode,
        CASE WHEN (o_custkey + l_suppkey * 3 + l_linenumber) % 17 = 0 OR o_custkey % 41 = 0 THEN NULL
             WHEN (o_custkey + l_suppkey) % 29 = 0 THEN CAST(0 AS DOUBLE)
             ELSE CAST((o_custkey * 7919 + l_suppkey * 104729 + l_linenumber * 13)
                       % (9000 * (1 + l_linenumber % 3)) AS DOUBLE) END AS t
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
GROUP BY point_id, facility_id, mode""",
    "access": """
SELECT p.point_id, p.district, p.region, p.weight, p.weight >= 2000 AS urban,
  CASE WHEN p.point_id % 19 = 0 THEN NULL ELSE CAST((p.point_id * 31) % 4000 AS DOUBLE) END AS snap_m,
  p.point_id % 19 <> 0 AS snap_ok,
  CASE WHEN p.point_id % 19 = 0 THEN true ELSE (p.point_id * 31) % 4000 > 2000 END AS off_network,
  m.t AS t_min, m.t IS NOT NULL AS reachable
FROM points p LEFT JOIN (SELECT point_id, min(duration_s) / 60 AS t FROM pairs
  WHERE mode = 1 AND resolutive GROUP BY point_id) m ON p.point_id = m.point_id""",
    "cells": """
SELECT o_orderkey AS cell_id, c_nationkey AS district,
  CAST(-81.4 AS DOUBLE) + CAST((o_orderkey * 41) % 1280 AS DOUBLE) / 100 AS lon,
  CAST(-18.4 AS DOUBLE) + CAST((o_orderkey * 59) % 1836 AS DOUBLE) / 100 AS lat, o_totalprice AS value
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "poverty": """
SELECT n_nationkey AS district_int,
  CASE WHEN n_nationkey = 7 THEN '#N/D' ELSE CAST((n_nationkey * 37) % 100 AS VARCHAR(10)) END AS rate_raw
FROM nation""",
    "geo": """
SELECT n_nationkey AS district,
  CAST(-81.4 AS DOUBLE) + (n_nationkey % 5) * CAST(2.56 AS DOUBLE) AS x0,
  CAST(-81.4 AS DOUBLE) + (n_nationkey % 5 + 1) * CAST(2.56 AS DOUBLE) AS x1,
  CAST(-18.4 AS DOUBLE) + CAST(floor(n_nationkey / 5) AS DOUBLE) * CAST(3.672 AS DOUBLE) AS y0,
  CAST(-18.4 AS DOUBLE) + (CAST(floor(n_nationkey / 5) AS DOUBLE) + 1) * CAST(3.672 AS DOUBLE) AS y1
FROM nation""",
    "tenders": """
SELECT o_orderkey AS ocid, CASE WHEN o_custkey % 97 = 13 THEN NULL ELSE o_custkey % 97 END AS buyer_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS category,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS published,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 7 END AS bidders,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 8 AS DOUBLE) END AS window_days_declared,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DOUBLE) / 2 END AS window_days_computed,
  CASE WHEN o_orderkey % 17 = 0 THEN ' corto ' ELSE concat('servicio ', o_orderpriority) END AS description,
  CASE o_orderkey % 5 WHEN 0 THEN 'Licitación Pública' WHEN 1 THEN 'Adjudicación Simplificada'
       WHEN 2 THEN 'Contratación Directa' WHEN 3 THEN 'Otro método' ELSE 'Subasta Inversa Electrónica' END AS method,
  month_file
FROM (SELECT o.*, '2026-06' AS month_file FROM orders o
      UNION ALL SELECT o.*, '2026-07' AS month_file FROM orders o WHERE o_orderkey % 50 = 0) x""",
    "parties": """
SELECT l_orderkey AS ocid, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey AS ord, l_suppkey AS entity_id,
  CASE WHEN l_linenumber <= 2 THEN 'Buyer;procuringEntity' ELSE 'tenderer' END AS roles,
  CASE WHEN l_orderkey % 4 = 0 OR l_suppkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN lower(n_name) ELSE n_name END AS department_raw,
  CASE WHEN l_orderkey % 8 = 0 THEN n_name ELSE NULL END AS region_raw,
  CASE WHEN l_orderkey % 3 = 0 THEN 'ZONA' WHEN l_orderkey % 3 = 1 THEN n_name
       ELSE concat(substr(n_name, 1, 5), 'X', substr(n_name, 6)) END AS locality_raw
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "awards": """
SELECT l_orderkey AS ocid, l_linenumber AS award_id, l_extendedprice AS amount, l_shipdate AS award_date
FROM lineitem WHERE l_returnflag <> 'N'""",
    "games": """
SELECT event_id AS game_id, ts, event_type AS mode,
  CASE WHEN event_id % 2 = 0 THEN 'white' ELSE 'black' END AS colour,
  2000 + CAST(floor(value) AS BIGINT) AS rating,
  CASE WHEN event_id % 10 < 6 THEN 'win' WHEN event_id % 10 < 9 THEN 'loss' ELSE 'draw' END AS result,
  CASE event_id % 3 WHEN 0 THEN 'mate' WHEN 1 THEN 'resign' ELSE 'outoftime' END AS ending FROM events""",
    "quotes": """
SELECT event_type AS currency, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS buy, max(value) AS sell
FROM events WHERE day(ts) % 6 <> 0 GROUP BY event_type, CAST(ts AS DATE)""",
    "calls": """
SELECT event_id AS call_id, ts, 'tarea1' AS task, event_type AS model,
  CAST(floor(value * 20) AS BIGINT) AS tokens_in,
  CASE WHEN user_id % 3 = 0 THEN CAST(floor(value * 12) AS BIGINT) ELSE 0 END AS tokens_hit,
  CAST(floor(value * 3) AS BIGINT) AS tokens_out, value / 100 AS latency_s, event_type <> 'error' AS ok FROM events""",
    "staff": """
SELECT c_custkey AS row_no, c_name AS full_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Femenino' WHEN 1 THEN 'Masculino' WHEN 2 THEN 'No binario' ELSE 'Prefiero no indicar' END AS gender,
  c_mktsegment AS area FROM customer""",
    "book": """
SELECT source AS doc, doc_id + 1 AS page,
  concat(CASE doc_id % 4 WHEN 0 THEN '34 NORMAS LEGALES Jueves 8 de enero de 2026  El Peruano / '
    WHEN 1 THEN concat('35NORMAS LEGALESJueves 8 de enero de 2026 El Peruano /', chr(10))
    WHEN 2 THEN concat(chr(10), '  12  ', chr(10), 'Página 3 de 10 ') ELSE '' END,
    text, CASE WHEN doc_id % 5 = 0 THEN concat(' contrata-', chr(10), 'ción   final', chr(10), chr(10), chr(10), chr(10), 'fin ') ELSE '' END) AS text
FROM documents""",
    "retrieval": """
SELECT vec_id, label, embedding, vec_id % 20 = 0 AS is_query,
  CASE WHEN vec_id % 100 = 0 THEN 'out_domain' ELSE 'in_domain' END AS kind,
  CASE WHEN vec_id % 3 = 0 THEN 'colloquial' ELSE 'formal' END AS style FROM embeddings""",
}


def _docs_spark(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("doc"), "source",
        F.posexplode(F.split("text", "\n")).alias("_p", "text"),
    ).select("doc", "source", (F.col("_p") + 1).alias("page"), "text")


# Tables whose text differs between the two engines: (inputs, Spark builder, DuckDB text).
DUAL: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], str]] = {
    "docs": (
        ("documents",), _docs_spark,
        """SELECT doc_id AS doc, source, unnest(range(1, len(parts) + 1)) AS page, unnest(parts) AS text
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents) x""",
    ),
}

_REF = re.compile(r"\b(FROM|JOIN)\s+([a-z]+)\b")


def _inputs(name: str) -> list[str]:
    if name in DUAL:
        return list(DUAL[name][0])
    return list(dict.fromkeys(m.group(2) for m in _REF.finditer(SHARED_SQL[name])))


def duck_with(names: tuple[str, ...]) -> str:
    """``WITH`` clause defining the named tables and everything they read, for DuckDB."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in ordered:
            return
        for dep in _inputs(n):
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    texts = [f"{n} AS ({DUAL[n][2] if n in DUAL else SHARED_SQL[n]})" for n in ordered]
    return "WITH " + ",\n".join(texts) if texts else ""


class Tables:
    """Lazy access to base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self.table = cache(self._table)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE_TABLES, *SHARED_SQL, *DUAL):
            raise AttributeError(name)
        return self.table(name)

    def _table(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        inputs = {dep: self.table(dep) for dep in _inputs(name)}
        if name in DUAL:
            return DUAL[name][1](**inputs)
        text = _REF.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", SHARED_SQL[name])
        return self.spark.sql(text, **inputs)
