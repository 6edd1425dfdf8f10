"""Readers with explicit schemas or declared headers; nothing is inferred from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almenara.functions import digest
from almenara.operators.inequality import load_poverty

# Column names of the published files.
GAME_SCHEMA = (
    "id_partida STRING, fecha STRING, modalidad STRING, variante STRING, clasificada STRING, color STRING, "
    "rating_propio INT, rating_rival INT, resultado STRING, estado_final STRING"
)
STAFF_COLUMNS = (
    "apellidos_nombres", "dni", "fecha_nacimiento", "genero", "telefono", "correo", "area", "puesto", "contrato",
    "sede", "fecha_ingreso", "modalidad",
)
PAGE_SCHEMA = "documento STRING, documento_desc STRING, version STRING, tipo STRING, pagina INT, texto STRING"
FRAGMENT_SCHEMA = (
    "id STRING, texto STRING, documento STRING, documento_desc STRING, version STRING, tipo STRING, pagina INT, "
    "n_en_pagina INT, caracteres INT"
)
TENDER_COLUMNS = {
    "Open Contracting ID": "ocid",
    "Entrega compilada:Licitación:ID de licitación": "id_licitacion",
    "Entrega compilada:Licitación:Título de la licitación": "titulo",
    "Entrega compilada:Licitación:Descripción de la licitación": "descripcion",
    "Entrega compilada:Comprador:Nombre de la Organización": "comprador",
    "Entrega compilada:Comprador:ID de Organización": "comprador_id",
    "Entrega compilada:Licitación:Categoría principal de contratación": "categoria",
    "Entrega compilada:Licitación:Detalles del método de contratación": "metodo",
    "Entrega compilada:Licitación:Valor:Monto": "monto",
    "Entrega compilada:Licitación:Valor:Moneda": "moneda",
    "compiledRelease/tender/datePublished": "fecha_publicacion",
    "Entrega compilada:Licitación:Número de licitantes": "n_licitantes",
    "Entrega compilada:Licitación:Periodo de licitación:Fecha de inicio": "licitacion_inicio",
    "Entrega compilada:Licitación:Periodo de licitación:Fecha de fin": "licitacion_fin",
    "Entrega compilada:Segmentación:ID": "segmento",
    "Entrega compilada:Licitación:Periodo de consulta:Fecha de inicio": "consulta_inicio",
    "Entrega compilada:Licitación:Periodo de consulta:Fecha de fin": "consulta_fin",
    "Entrega compilada:Licitación:Periodo de consulta:Duración (días)": "consulta_dias",
}
PARTY_COLUMNS = {
    "Open Contracting ID": "ocid",
    "Entrega compilada:Partes involucradas:ID de Entidad": "entidad_id",
    "Entrega compilada:Partes involucradas:Nombre común": "entidad_nombre",
    "Entrega compilada:Partes involucradas:Roles de las partes": "roles",
    "Entrega compilada:Partes involucradas:Dirección:Departamento": "departamento_crudo",
    "Entrega compilada:Partes involucradas:Dirección:Región": "region_cruda",
    "Entrega compilada:Partes involucradas:Dirección:Localidad": "localidad_cruda",
}
AWARD_COLUMNS = {
    "Open Contracting ID": "ocid",
    "Entrega compilada:Adjudicaciones:ID de Adjudicación": "id_adjudicacion",
    "Entrega compilada:Adjudicaciones:Valor:Monto": "monto_adjudicado",
    "Entrega compilada:Adjudicaciones:Fecha de adjudicación": "fecha_adjudicacion",
}
# End of the fixed values.

#: Bytes of a file that one task of the manifest reads.
STRETCH_BYTES = 256 << 20

_BOM = "﻿"


def text_encoding(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> str:
    """UTF-8 if every line is valid UTF-8, else ``fallback``; one distributed pass over the lines."""
    lines = spark.read.text(path)
    broken = lines.filter(~F.is_valid_utf8("value")).limit(1).count()
    return fallback if broken else "UTF-8"


def read_registry(
    spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None, fallback: str = "ISO-8859-1"
) -> DataFrame:
    """Delimited registry in which every column is text; a byte-order mark is removed."""
    chosen = encoding or text_encoding(spark, path, fallback)
    df = spark.read.option("header", True).option("sep", sep).option("encoding", chosen).csv(path)
    return df.withColumnsRenamed({c: c.lstrip(_BOM).lstrip("ï»¿") for c in df.columns})


def select_mapped(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The mapped columns under their short names, and the mapped columns the source lacks."""
    present = {c.lstrip(_BOM): c for c in df.columns}
    missing = [c for c in mapping if c not in present]
    return df.select(*[F.col(f"`{present[c]}`").alias(s) for c, s in mapping.items() if c in present]), missing


def read_monthly(
    spark: SparkSession, paths: list[str], mapping: dict[str, str], month_pattern: str = r"(\d{4}-\d{2})"
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Monthly files under short names with ``month_file`` from the file name; files may lack columns.

    Files of the same header are one scan, so the plan grows with the kinds of header, not with the months. Only the
    header of each path is read beforehand.
    """
    def csv() -> DataFrameReader:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"')

    headers: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        headers.setdefault(tuple(csv().csv(path).columns), []).append(path)
    parts, missing = [], {}
    for columns, own in headers.items():
        raw = csv().schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(own)
        short, lacking = select_mapped(raw, mapping)
        missing.update({path: list(lacking) for path in own})
        parts.append(short.withColumn("month_file", F.regexp_extract(F.col("_metadata.file_path"), month_pattern, 1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), {path: missing[path] for path in paths}


def read_poverty(spark: SparkSession, path: str, key: str = "UBIGEO1", rate: str = "POVERTY_RATE") -> DataFrame:
    """Lookup CSV with integer keys and spreadsheet error marks."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip(_BOM) for c in df.columns})
    return load_poverty(df, key, rate)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAGMENT_SCHEMA).json(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet with only the named columns read."""
    return spark.read.parquet(path).select(*columns)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Game records under the names the game statistics use."""
    raw = spark.read.option("header", True).schema(GAME_SCHEMA).csv(path)
    return raw.select(
        F.col("id_partida").alias("game_id"), F.col("fecha").try_cast("timestamp").alias("ts"),
        F.col("modalidad").alias("mode"), F.col("variante").alias("variant"),
        (F.lower("clasificada") == "true").alias("rated"), F.col("color").alias("colour"),
        F.col("rating_propio").alias("rating"), F.col("rating_rival").alias("rating_opponent"),
        F.col("resultado").alias("result"), F.col("estado_final").alias("ending"),
    )


def read_staff(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} STRING" for c in STAFF_COLUMNS)
    return spark.read.option("header", True).schema(schema).csv(path)


def _address(spark: SparkSession, path: str) -> str:
    """Where the file lies after mount points, as a URI that tasks can open."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(at).toUri().toString()


def long_digests(spark: SparkSession, files: DataFrame, stretch: int) -> DataFrame:
    """``path, sha256`` of files that are longer than ``stretch``.

    SHA-256 is one chain over the bytes of a file. It is followed in turns: in each, one task a file reads one stretch and
    hands on the state of the chain. The driver holds a row of about 200 bytes for a file, never its bytes.
    """
    todo = [(r.path, _address(spark, r.path), r.length, b"") for r in files.select("path", "length").collect()]
    stretch = stretch if digest.resumable() else max((length for _, _, length, _ in todo), default=stretch)
    done, at = [], 0
    while todo:
        def turn(row: tuple, at: int = at) -> tuple:
            path, address, length, state = row
            return path, address, length, digest.advance(address, state, at, min(at + stretch, length), length)

        # A slice for each file, so that no task reads two stretches.
        rows = spark.sparkContext.parallelize(todo, len(todo)).map(turn).collect()
        at += stretch
        done += [(path, state.decode()) for path, _, length, state in rows if length <= at]
        todo = [row for row in rows if row[2] > at]
    return spark.createDataFrame(done, "path string, sha256 string")


def file_manifest(spark: SparkSession, pattern: str, stretch: int = STRETCH_BYTES) -> DataFrame:
    """Name, bytes, SHA-256 and time of every file; files over ``stretch`` bytes are read when this is called."""
    files = spark.read.format("binaryFile").load(pattern)
    long_ = files.filter(F.col("length") > stretch)
    hashed = files.filter(F.col("length") <= stretch).withColumn("sha256", F.sha2("content", 256)).drop("content").unionByName(
        long_.drop("content").join(long_digests(spark, long_, stretch), "path")
    )
    return hashed.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        "sha256", F.col("modificationTime").alias("modified"),
    )


def verify_manifest(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files with whether they exist and agree in size and hash."""
    e = expected.select("name", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    joined = e.join(manifest, "name", "left")
    found = F.col("bytes").isNotNull()
    return joined.select(
        "name", found.alias("found"), F.coalesce(F.col("bytes") == F.col("_b"), F.lit(False)).alias("same_size"),
        F.coalesce(F.col("sha256") == F.col("_h"), F.lit(False)).alias("same_hash"),
    )
