"""Readers, writers, cache, manifest and the incremental stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from almenara.functions import digest
from almenara.operators import costs
from almenara.sources import readers, sinks
from almenara.streaming.incremental import load_stream


def test_registry_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("﻿COD;NOMBRE;NORTE\n001;Peñón;-12.5\n".encode("utf-8"))
    df = readers.read_registry(spark, str(p))
    assert df.columns == ["COD", "NOMBRE", "NORTE"] and set(dict(df.dtypes).values()) == {"string"}
    assert tuple(df.first()) == ("001", "Peñón", "-12.5")


def test_registry_falls_back_to_latin_1(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("COD;NOMBRE\n1;Peñón\n".encode("latin-1"))
    assert readers.text_encoding(spark, str(p)) == "ISO-8859-1"
    assert readers.read_registry(spark, str(p)).first().NOMBRE == "Peñón"


def test_monthly_files_with_missing_columns(spark, tmp_path):
    (tmp_path / "2026-06_x.csv").write_text("Open Contracting ID,Extra,B\n1,e,\"a\nb\"\n", encoding="utf-8")
    (tmp_path / "2026-07_x.csv").write_text("B,Open Contracting ID\nc,2\n", encoding="utf-8")
    (tmp_path / "2026-08_x.csv").write_text("Open Contracting ID\n3\n", encoding="utf-8")
    paths = sorted(str(p) for p in tmp_path.glob("*.csv"))
    df, missing = readers.read_monthly(spark, paths, {"Open Contracting ID": "ocid", "B": "b"})
    assert sorted((r.ocid, r.b, r.month_file) for r in df.filter("b is not null").collect()) == [("1", "a\nb", "2026-06"), ("2", "c", "2026-07")]
    assert [m for m in missing.values()] == [[], [], ["B"]] and df.count() == 3


def test_months_of_one_header_are_one_scan(spark, tmp_path):
    for m in range(1, 10):
        (tmp_path / f"2026-0{m}.csv").write_text(("A,B\n%d,x\n" if m % 2 else "B,A\nx,%d\n") % m, encoding="utf-8")
    df, missing = readers.read_monthly(spark, sorted(str(p) for p in tmp_path.glob("*.csv")), {"A": "a", "B": "b", "C": "c"})
    assert sorted((r.a, r.b, r.month_file) for r in df.collect()) == [(str(m), "x", f"2026-0{m}") for m in range(1, 10)]
    assert len(missing) == 9 and all(m == ["C"] for m in missing.values())
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_poverty_lookup(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_bytes("﻿UBIGEO1,POVERTY_RATE\n10101,12.5\n250101,#N/D\n".encode("utf-8"))
    assert [tuple(r) for r in readers.read_poverty(spark, str(p)).collect()] == [("010101", 12.5)]


def test_pages_fragments_games_and_staff(spark, tmp_path):
    pages = spark.createDataFrame([("ley", "Ley ñ", "v", "ley", 3, "texto\nlargo")], readers.PAGE_SCHEMA)
    sinks.write_json_lines(pages, str(tmp_path / "pages"))
    assert readers.read_pages(spark, str(tmp_path / "pages")).collect() == pages.collect()
    g = tmp_path / "g.csv"
    g.write_text("id_partida,fecha,modalidad,variante,clasificada,color,rating_propio,rating_rival,resultado,estado_final\n"
                 "a,2024-06-22 18:48:13.647,bullet,standard,True,black,3079,2441,win,resign\n", encoding="utf-8")
    r = readers.read_games(spark, str(g)).first()
    assert (r.game_id, r.rated, r.rating, r.ts.microsecond, r.ending) == ("a", True, 3079, 647000, "resign")
    s = tmp_path / "s.csv"
    s.write_text(",".join(readers.STAFF_COLUMNS) + "\n" + ",".join("x" * len(readers.STAFF_COLUMNS)) + "\n", encoding="utf-8")
    assert readers.read_staff(spark, str(s)).first().sede == "x"


def test_tables_are_partitioned_and_read_by_column(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, region string, v double")
    sinks.write_table(df, str(tmp_path / "t"), ("region",))
    assert (tmp_path / "t" / "region=a").exists()
    out = readers.read_columns(spark, str(tmp_path / "t"), ["id", "region"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]
    assert "ReadSchema: struct<id:int>" in out._jdf.queryExecution().toString()
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_call_log_only_grows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-09-22 02:18:15", "t", "m", 10, 0, 5, 0.5, True)], "call_id int, t string, task string, model string, tokens_in long, tokens_hit long, tokens_out long, latency_s double, ok boolean")
    costed = costs.add_costs(df.withColumn("ts", F.col("t").cast("timestamp")))
    for _ in range(3):
        sinks.append_calls(costed, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_cache_key_ignores_order_and_sees_changes(spark):
    a, b = spark.range(50), spark.range(20)
    key = sinks.cache_key("car", a, b, "id", "id")
    assert key == sinks.cache_key("car", a.repartition(7).orderBy(F.desc("id")), b, "id", "id")
    assert key != sinks.cache_key("foot", a, b, "id", "id")
    assert key != sinks.cache_key("car", spark.range(51), b, "id", "id")
    assert key != sinks.cache_key("car", b, a, "id", "id")


def test_cached_table_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert sinks.cached_table(spark, str(tmp_path), "abc", compute, force).count() == 3
    assert len(calls) == 2


def test_manifest_and_its_check(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hola")
    (tmp_path / "b.bin").write_bytes(b"otro")
    m = readers.file_manifest(spark, str(tmp_path / "*.bin"))
    got = {r.name: (r.bytes, r.sha256) for r in m.collect()}
    assert got["a.bin"] == (4, hashlib.sha256(b"hola").hexdigest())
    expected = spark.createDataFrame([("a.bin", 4, got["a.bin"][1]), ("b.bin", 5, "x"), ("c.bin", 1, "y")], "name string, bytes long, sha256 string")
    out = {r.name: (r.found, r.same_size, r.same_hash) for r in readers.verify_manifest(m, expected).collect()}
    assert out == {"a.bin": (True, True, True), "b.bin": (True, False, False), "c.bin": (False, False, False)}


def test_manifest_of_files_longer_than_a_stretch(spark, tmp_path):
    sizes = {"one.bin": 1, "whole.bin": 100, "a b#1.bin": 101, "even.bin": 300, "long.bin": 1234}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(i * i % 251 for i in range(n)))
    expected = {name: (n, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()) for name, n in sizes.items()}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.m.link./in", f"file://{tmp_path}")
    for pattern in (f"{tmp_path}/*.bin", "viewfs://m/in/*.bin"):
        m = readers.file_manifest(spark, pattern, stretch=100)
        assert {r.name: (r.bytes, r.sha256) for r in m.collect()} == expected
        assert m.schema == readers.file_manifest(spark, pattern).schema and m.filter("modified is null").isEmpty()


def test_manifest_reads_a_stretch_at_a_time(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    m = readers.file_manifest(spark, str(tmp_path / "*.bin"), stretch=300)
    state = b""
    for at in (0, 300, 600, 900):
        state = digest.advance(str(tmp_path / "a.bin"), state, at, min(at + 300, 1000), 1000)
    assert state.decode() == m.first().sha256 == hashlib.sha256(b"x" * 1000).hexdigest()
    with pytest.raises(OSError, match="ends at byte 1000"):
        digest.advance(str(tmp_path / "a.bin"), b"", 0, 1001, 1001)


def test_manifest_of_a_file_that_the_binary_source_refuses(spark, tmp_path):
    with (tmp_path / "a.bin").open("wb") as f:
        f.truncate(2**31 + 5)
        f.seek(2**31)
        f.write(b"tail")
    with (tmp_path / "a.bin").open("rb") as f:
        expected = hashlib.file_digest(f, "sha256").hexdigest()
    assert [(r.bytes, r.sha256) for r in readers.file_manifest(spark, str(tmp_path / "*.bin")).collect()] == [(2**31 + 5, expected)]


def test_stream_load_adds_each_fragment_once(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "index")
    for step, ids in enumerate((["x", "y"], ["y", "z"])):
        spark.createDataFrame([(i, step) for i in ids], "id string, v int").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id string, v int").parquet(str(src))
        load_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("name", ["TENDER_COLUMNS", "PARTY_COLUMNS", "AWARD_COLUMNS"])
def test_column_maps_are_one_to_one(name):
    m = getattr(readers, name)
    assert len(set(m.values())) == len(m) and m["Open Contracting ID"] == "ocid"
