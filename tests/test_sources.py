"""Sources, sinks, integrity, streams, and the driver's entry."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import integrity
from auditlake.session import table
from auditlake.sources import adapters, files, sinks, sqlite
from auditlake.streaming import counts

SF = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_detection(tmp_path):
    assert files.detect(write(tmp_path / "a.csv", "x,y\n1,2\n")) == "csv"
    assert files.detect(write(tmp_path / "b.csv", '{"x": 1}\n{"x": 2}\n')) == "ndjson"
    assert files.detect(write(tmp_path / "c.txt", '[{"x": 1}]')) == "json"
    assert files.detect(write(tmp_path / "d.json", '{"records": [\n{"x": 1}]}')) == "json"
    sqlite3.connect(tmp_path / "e.csv").execute("CREATE TABLE t (x)").connection.commit()
    assert files.detect(str(tmp_path / "e.csv")) == "sqlite"


def test_csv_variants(spark, tmp_path):
    df = files.load(spark, write(tmp_path / "a.csv", 'x,y\n1,"a, ""b""\nc"\n2, \n'))
    assert [tuple(r) for r in df.orderBy("x").collect()] == [(1, 'a, "b"\nc'), (2, None)]
    assert files.load(spark, write(tmp_path / "b.tsv", "x\ty\n1\tü\n")).first().y == "ü"
    assert files.load(spark, write(tmp_path / "c.csv", "x,y\n1,ü €\n", "cp1252")).first().y == "ü €"
    assert files.read_csv(spark, write(tmp_path / "d.csv", "x\n007\n"), raw=True).first().x == "007"
    assert files.load(spark, write(tmp_path / "e.csv", "x,y\n")).count() == 0


def test_json_variants(spark, tmp_path):
    rows = [{"x": 1, "y": "a"}, {"x": 2, "z": [1]}]
    for name, text in (("a.json", json.dumps(rows)), ("b.json", json.dumps({"records": rows, "n": 2})), ("c.ndjson", "\n".join(map(json.dumps, rows)))):
        df = files.load(spark, write(tmp_path / name, text))
        assert df.count() == 2 and set(df.columns) == {"x", "y", "z"}, name
    with pytest.raises(Exception):
        files.load(spark, write(tmp_path / "d.ndjson", '{"x": 1}\n{"x": \n')).collect()


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "x.db")
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}" if i % 3 else None) for i in range(50)])
    c.close()
    df = files.load(spark, p)
    assert df.count() == 50 and df.where("b IS NULL").count() == 17
    assert sqlite.read_sqlite(spark, p, query="SELECT a FROM t WHERE a < 5").count() == 5
    for q in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) DELETE FROM t", "PRAGMA x"):
        with pytest.raises(ValueError):
            sqlite.guarded(q)
    with pytest.raises(ValueError):
        sqlite.only_table(p, "nope")


def test_union_ordinal_and_cap(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2)], "b string, c int")
    assert files.union([a, b]).columns == ["a", "b", "c"]
    assert files.with_ordinal(a).columns[-1] == "row_ordinal"
    df, warning = files.row_cap(spark.range(5), 3)
    assert df.count() == 3 and warning
    assert files.row_cap(spark.range(5))[1] is None
    with pytest.raises(ValueError):
        files.load(spark, SF + "/region.parquet", "nope")


def test_adapters_and_packages(spark, tmp_path):
    adapters.register_adapter("mine", lambda: [{"a": 1}, {"b": None, "a": "x"}])
    assert adapters.read_adapter(spark, "mine").columns == ["a", "b"]
    with pytest.raises(ValueError):
        adapters.register_adapter("http://x", list)
    good, bad = tmp_path / "g.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/a.csv", "x\n1\n")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../a.csv", "x\n1\n")
    assert [p.name for p in adapters.unpack(str(good), str(tmp_path / "out"))] == ["a.csv"]
    with pytest.raises(ValueError):
        adapters.unpack(str(bad), str(tmp_path / "out2"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, 'a"b')], "row_id int, x double, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(rows, key=lambda r: r["row_id"]) == [{"row_id": 1, "x": None, "s": None}, {"row_id": 2, "x": 1.5, "s": 'a"b'}]
    sinks.write_csv(df, str(tmp_path / "c"), ["s", "row_id", "extra"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["s", "row_id", "extra"] and back.where("row_id = 2").first().s == 'a"b'
    sinks.write_aggregate(df, str(tmp_path / "a"))
    assert "row_id" not in json.loads(spark.read.text(str(tmp_path / "a")).first().value)
    assert "row_id" in sinks.text_report("t", df)


def test_integrity(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.csv", "x\n1\n")
    write(tmp_path / "in/b.csv", "x\n2\n")
    d = integrity.file_digests(spark, str(tmp_path / "in"))
    manifest = spark.createDataFrame(d.collect(), d.schema)
    integrity.gate(manifest, d)
    assert manifest.where("name = 'a.csv'").first().sha256 == integrity.large_file_digest(str(tmp_path / "in/a.csv"))
    write(tmp_path / "in/b.csv", "x\n3\n")
    (tmp_path / "in/a.csv").unlink()
    write(tmp_path / "in/c.csv", "x\n")
    got = {r.name: r.status for r in integrity.verify(manifest, integrity.file_digests(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.csv": "MISSING", "b.csv": "INTEGRITY_FAILED", "c.csv": "UNREGISTERED"}
    with pytest.raises(ValueError):
        integrity.gate(manifest, integrity.file_digests(spark, str(tmp_path / "in")))
    assert integrity.safe_name("../a b.csv").startswith("a_b.csv-")
    with pytest.raises(ValueError):
        integrity.within(str(tmp_path), "../x")


def test_stream_equals_batch(spark, tmp_path):
    batch = counts.windowed(table(spark, SF, "events"), "ts", ["event_type"])
    src = spark.readStream.schema(table(spark, SF, "events").schema).parquet(f"{SF}/events.parquet*")
    got = counts.run_to_files(counts.windowed(src, "ts", ["event_type"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.agg(F.sum("n")).first()[0] == table(spark, SF, "events").count()


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
