"""Queries that write tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from almenara.operators import costs, index
from almenara.operators import documents as docs
from almenara.plans.document_queries import _FIXED
from almenara.plans.registry import query
from almenara.plans.series_queries import _COST
from almenara.session import scratch
from almenara.sources import readers, sinks


@query("file_manifest")
def _manifest(t):
    return readers.file_manifest(t.spark, f"{t.folder}/*.parquet").drop("modified")


@query("parquet_round_trip", ("access",), "SELECT region, point_id, t_min FROM access")
def _parquet(t):
    path = scratch(t.spark, "access")
    sinks.write_table(t.access, path, ("region",))
    return readers.read_columns(t.spark, path, ["region", "point_id", "t_min"])


@query("csv_round_trip", ("facilities",), "SELECT CAST(facility_id AS VARCHAR) AS facility_id, CAST(ord AS VARCHAR) AS ord, lat_raw, lon_raw FROM facilities")
def _csv(t):
    path = scratch(t.spark, "facilities")
    sinks.write_csv(t.facilities.select("facility_id", "ord", "lat_raw", "lon_raw"), path)
    return readers.read_registry(t.spark, path, sep=",")


@query("json_lines_round_trip", ("book",), "SELECT doc AS documento, CAST(page AS INTEGER) AS pagina, md5(text) AS digest FROM book")
def _json(t):
    path = scratch(t.spark, "pages")
    sinks.write_json_lines(t.book.select(
        F.col("doc").alias("documento"), F.col("page").cast("int").alias("pagina"), F.col("text").alias("texto")
    ), path)
    return readers.read_pages(t.spark, path).select("documento", "pagina", F.md5("texto").alias("digest"))


@query("call_log_round_trip", ("calls",), f", {_COST} SELECT call_id, task, band, cost_usd FROM cc")
def _log(t):
    path = scratch(t.spark, "calls")
    costed = costs.add_costs(t.calls)
    for ok in (True, False):
        sinks.append_calls(costed.filter(F.col("ok") == ok), path)
    return t.spark.read.parquet(path).select("call_id", "task", "band", "cost_usd")


@query("fragment_json_round_trip", ("book",), f""", {_FIXED} SELECT id, doc AS documento, CAST(page AS INTEGER) AS pagina,
n_in_page AS n_en_pagina, chars AS caracteres FROM fx""")
def _fragments(t):
    path = scratch(t.spark, "fragments")
    chunks = docs.fixed_windows(t.book).select(
        "id", F.col("text").alias("texto"), F.col("doc").alias("documento"), F.col("page").cast("int").alias("pagina"),
        F.col("n_in_page").alias("n_en_pagina"), F.col("chars").alias("caracteres"),
    )
    sinks.write_json_lines(chunks, path)
    return readers.read_fragments(t.spark, path).select("id", "documento", "pagina", "n_en_pagina", "caracteres")


@query("index_loaded_twice", ("book",), f", {_FIXED} SELECT id, doc, chars FROM fx")
def _index(t):
    """The second load brings rows that are stored already; each is kept once."""
    path = scratch(t.spark, "index")
    chunks = docs.fixed_windows(t.book).select("id", "doc", "chars")
    for rows in (chunks.filter(F.col("chars") >= 800), chunks):
        index.load_index(rows, path)
    return index.read_index(t.spark, path)


_MONTHLY = {"Open Contracting ID": "ocid", "Categoría": "category", "Descripción": "description", "Pliego": "office"}


@query("monthly_files_union", ("tenders",), """SELECT CAST(ocid AS VARCHAR) AS ocid, CASE WHEN month_file <> '2026-07' THEN category END AS category,
description, month_file FROM tenders""")
def _months(t):
    """One folder per month under raw column names; the last month lacks a column, and a mapped one is in none."""
    path = scratch(t.spark, "monthly")
    raw = t.tenders.select(F.col("ocid").alias("Open Contracting ID"), F.col("category").alias("Categoría"), F.col("description").alias("Descripción"), "month_file")
    months = sorted(r.month_file for r in t.tenders.select("month_file").distinct().collect())  # one row per month
    for month in months:
        own = raw.filter(F.col("month_file") == month).drop("month_file", *(["Categoría"] if month == "2026-07" else []))
        own.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{month}")
    return readers.read_monthly(t.spark, [f"{path}/{m}" for m in months], _MONTHLY)[0].select("ocid", "category", "description", "month_file")


@query("game_file_round_trip", ("games",), """SELECT CAST(game_id AS VARCHAR) AS game_id, ts, mode, game_id % 2 = 0 AS rated, colour,
CAST(rating AS INTEGER) AS rating, result, ending FROM games""")
def _games(t):
    path = scratch(t.spark, "games")
    sinks.write_csv(t.games.select(
        F.col("game_id").alias("id_partida"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fecha"), F.col("mode").alias("modalidad"),
        F.lit("standard").alias("variante"), F.when(F.col("game_id") % 2 == 0, "True").otherwise("False").alias("clasificada"), F.col("colour").alias("color"),
        F.col("rating").alias("rating_propio"), F.col("rating").alias("rating_rival"), F.col("result").alias("resultado"), F.col("ending").alias("estado_final"),
    ), path)
    return readers.read_games(t.spark, path).select("game_id", "ts", "mode", "rated", "colour", "rating", "result", "ending")


@query("staff_file_round_trip", ("staff",), "SELECT full_name AS apellidos_nombres, gender AS genero, area FROM staff")
def _staff(t):
    path = scratch(t.spark, "staff")
    known = {"apellidos_nombres": F.col("full_name"), "genero": F.col("gender"), "area": F.col("area")}
    sinks.write_csv(t.staff.select(*[known.get(c, F.col("row_no").cast("string")).alias(c) for c in readers.STAFF_COLUMNS]), path)
    return readers.read_staff(t.spark, path).select(*known)


@query("cached_travel_table", ("access",), "SELECT region, count(*) AS points, round(sum(coalesce(t_min, 0)), 3) AS minutes FROM access GROUP BY region")
def _cached(t):
    """The second call finds the table of the first; what it would compute is empty."""
    folder = scratch(t.spark, "cache")
    key = sinks.cache_key("car", t.access, t.access, "point_id", "point_id")
    by_region = t.access.select("region", "point_id", "t_min")
    sinks.cached_table(t.spark, folder, key, lambda: by_region)
    found = sinks.cached_table(t.spark, folder, key, lambda: by_region.limit(0))
    return found.groupBy("region").agg(F.count("*").alias("points"), F.round(F.sum(F.coalesce("t_min", F.lit(0.0))), 3).alias("minutes"))
