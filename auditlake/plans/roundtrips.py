"""Registered queries of sources, sinks and evidence: tables written in a format, read back, and compared with themselves.

Files go to a folder of their own below the shared checkpoint folder.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import evidence, integrity
from auditlake.session import ensure_checkpoint_dir, table
from auditlake.sources import adapters, files, sinks, sqlite

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/trip-{uuid.uuid4().hex}"


def _local(folder: str) -> Path:
    """The folder as a path of this machine's file system, made if need be."""
    p = Path(folder.removeprefix("file:"))
    p.mkdir(parents=True, exist_ok=True)
    return p


_BLANK = r"CASE WHEN regexp_replace({c}, '^\s+|\s+$', '', 'g') <> '' THEN {c} END AS {c}"
_ALERTS = "SELECT row_id, " + ", ".join(_BLANK.format(c=c) for c in ("alert_id", "alert_name", "severity", "category", "source_system")) + " FROM alert_context"
_COLUMNS = ["row_id", "alert_id", "alert_name", "severity", "category", "source_system"]


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alert_context").select(*_COLUMNS)


@query(_ALERTS)
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    to = _folder(spark)
    sinks.write_csv(_alerts(spark, d), to)
    return files.load(spark, to, "csv").select(F.col("row_id").cast("bigint").alias("row_id"), *_COLUMNS[1:])


_NOTES = r"SELECT row_id, CASE WHEN regexp_replace(n, '^\s+|\s+$', '', 'g') <> '' THEN n END AS note FROM (SELECT row_id, replace(replace(analyst_findings, chr(13), ' '), chr(10), ' | ') AS n FROM dataset_operational_pattern_renamed)"


@query(_NOTES)
def src_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Free text with quotes and commas, separated by tabs, every column as text."""
    to = _folder(spark) + ".tsv"
    note = F.replace(F.replace("analyst_findings", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" | "))
    table(spark, d, "dataset_operational_pattern_renamed").select("row_id", note.alias("note")).write.option("header", True).option("sep", "\t").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(to)
    t = files.load(spark, to, "csv", raw=True, sep="\t")
    return t.select(F.col("row_id").cast("bigint").alias("row_id"), "note")


@query(_ALERTS)
def src_ndjson(spark: SparkSession, d: str) -> DataFrame:
    to = _folder(spark)
    sinks.write_json(_alerts(spark, d), to)
    return files.load(spark, to, "ndjson").select(*_COLUMNS)


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def src_json(spark: SparkSession, d: str) -> DataFrame:
    """Records inside an envelope object, one file."""
    to = _local(_folder(spark)) / "customers.json"
    rows = [r.asDict() for r in table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").toLocalIterator()]
    to.write_text(json.dumps({"source": "x", "records": [{k: float(v) if k == "c_acctbal" else v for k, v in r.items()} for r in rows]}))
    return files.load(spark, str(to)).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, true AS same FROM nation")
def src_pair(spark: SparkSession, d: str) -> DataFrame:
    """The typed and the text view of one file hold the same records."""
    to = _folder(spark)
    sinks.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), to)
    typed, text = files.open_pair(spark, to, "csv")
    j = typed.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name").join(text.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("t")), F.col("n_name") == F.col("t"))
    return j.select("n_nationkey", "n_name", (F.col("k") == F.col("n_nationkey").cast("string")).alias("same"))


def _database(spark: SparkSession, d: str) -> str:
    to = _local(_folder(spark)) / "tables.db"
    with sqlite3.connect(to) as c:
        for name, cols in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"])):
            c.execute(f"CREATE TABLE {name} ({', '.join(cols)})")
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(cols))})", [tuple(r) for r in table(spark, d, name).select(*cols).collect()])  # two fixed tables of 25 and 5 rows
    return str(to)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def src_sqlite_table(spark: SparkSession, d: str) -> DataFrame:
    return files.load(spark, _database(spark, d), "sqlite", table="nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'")
def src_sqlite_query(spark: SparkSession, d: str) -> DataFrame:
    return sqlite.read_sqlite(spark, _database(spark, d), query="SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'")


@query("SELECT * FROM (VALUES ('a.csv', 'csv', ','), ('b.txt', 'csv', chr(9)), ('c.csv', 'ndjson', ','), ('d.json', 'json', ','), ('e.db', 'sqlite', ','), ('f.tsv', 'csv', chr(9))) AS t(name, kind, separator)")
def src_detect(spark: SparkSession, d: str) -> DataFrame:
    """What each file is: the content decides where the name says otherwise."""
    at = _local(_folder(spark))
    for name, data in (("a.csv", b"x,y\n1,2\n"), ("b.txt", b"x\ty\n1\t2\n"), ("c.csv", b'{"x": 1}\n{"x": 2}\n'), ("d.json", b'[{"x": 1}]'), ("f.tsv", b"x\n1\n")):
        (at / name).write_bytes(data)
    with sqlite3.connect(at / "e.db") as c:
        c.execute("CREATE TABLE t (x)")
    return spark.createDataFrame([(p.name, files.detect(str(p)), files.separator(str(p))) for p in sorted(at.iterdir())], "name string, kind string, separator string")


@query("SELECT * FROM (VALUES ('utf-8', 'Käse – €'), ('cp1252', 'Käse – €')) AS t(encoding, text)")
def src_encoding(spark: SparkSession, d: str) -> DataFrame:
    at, out = _local(_folder(spark)), None
    for e in ("utf-8", "cp1252"):
        (at / f"{e}.csv").write_bytes("text\nKäse – €\n".encode(e))
        one = files.load(spark, str(at / f"{e}.csv")).select(F.lit(files.encoding(str(at / f"{e}.csv"))).alias("encoding"), "text")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS a, CAST(NULL AS VARCHAR) AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def src_union(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return files.union([n.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("a")), r.select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("b"))])


@query("SELECT n_nationkey, n_name, inner_name, inner_list FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS inner_name, n_name || '|' AS inner_list FROM nation)")
def src_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Blanks become NULL inside structs and arrays too."""
    t = table(spark, d, "nation")
    inner = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("  ").alias("name"))
    n = files.normalise(t.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", inner.alias("s"), F.array("n_name", F.lit(" ")).alias("a")))
    return n.select("n_nationkey", "n_name", F.col("s.name").alias("inner_name"), F.concat_ws("|", F.transform("a", lambda x: F.coalesce(x, F.lit("")))).alias("inner_list"))


@query("SELECT r_name AS name FROM region")
def src_package(spark: SparkSession, d: str) -> DataFrame:
    """A ZIP package, checked member by member, unpacked and read."""
    at = _local(_folder(spark))
    with zipfile.ZipFile(at / "p.zip", "w") as z:
        z.writestr("regions/part.csv", "name\n" + "\n".join(r.r_name for r in table(spark, d, "region").collect()) + "\n")  # five rows
    out = adapters.unpack(str(at / "p.zip"), str(at / "open"))
    return files.load(spark, str(next(p for p in map(Path, out) if p.suffix == ".csv")))


@query("SELECT lower(n_name) AS name FROM nation")
def src_adapter(spark: SparkSession, d: str) -> DataFrame:
    names = [r.n_name for r in table(spark, d, "nation").select("n_name").collect()]  # 25 rows
    adapters.register_adapter("nations", lambda: [{"name": n.lower()} for n in names])
    return adapters.read_adapter(spark, "nations")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS balance, s_name FROM supplier")
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    """NaN and infinity leave as null, null fields stay."""
    to = _folder(spark)
    bad = F.when(F.col("s_suppkey") % 6 == 0, float("nan")).when(F.col("s_suppkey") % 3 == 0, float("inf")).otherwise(F.col("s_acctbal").cast("double"))
    sinks.write_json(table(spark, d, "supplier").select("s_suppkey", bad.alias("balance"), "s_name"), to)
    return spark.read.schema("s_suppkey bigint, balance double, s_name string").json(to)


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def sink_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate export holds no per-record columns."""
    to = _folder(spark)
    sinks.write_aggregate(table(spark, d, "nation").select("n_name", "n_regionkey", F.col("n_nationkey").alias("row_id"), F.lit("x").alias("evidence")), to)
    return spark.read.json(to).select("n_name", "n_regionkey")


@query("SELECT r_name, '' AS note, CAST(r_regionkey AS VARCHAR) AS r_regionkey FROM region")
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """Fixed column order, a missing column and missing values blank."""
    to = _folder(spark)
    sinks.write_csv(table(spark, d, "region").select("r_regionkey", "r_name"), to, ["r_name", "note", "r_regionkey"])
    t = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(to)
    return t.select("r_name", F.coalesce("note", F.lit("")).alias("note"), "r_regionkey")


@query("SELECT r_name || '.txt' AS name, sha256(r_name) AS sha256, CAST(length(r_name) AS BIGINT) AS bytes, CASE WHEN r_regionkey = 1 THEN 'INTEGRITY_FAILED' ELSE 'VERIFIED' END AS status FROM region UNION ALL SELECT 'gone.txt', NULL, NULL, 'MISSING'")
def hash_files(spark: SparkSession, d: str) -> DataFrame:
    """Digests of files read in parallel, checked against a manifest with one changed and one missing entry."""
    at = _local(_folder(spark))
    r = table(spark, d, "region")
    for x in r.collect():  # five rows
        (at / f"{x.r_name}.txt").write_text(x.r_name)
    seen = integrity.file_digests(spark, str(at))
    manifest = r.select(F.concat("r_name", F.lit(".txt")).alias("name"), F.when(F.col("r_regionkey") == 1, "0").otherwise(F.sha2("r_name", 256)).alias("sha256")).unionByName(spark.createDataFrame([("gone.txt", "1")], "name string, sha256 string"))
    return integrity.verify(manifest, seen).join(seen, "name", "left").select("name", "sha256", "bytes", "status")


@query("SELECT * FROM (VALUES ('a.txt', 'VERIFIED', 'VERIFIED', true), ('b.txt', 'VERIFIED', 'INTEGRITY_FAILED', false), ('c.txt', 'VERIFIED', 'MISSING', false)) AS t(name, original, working, opens)")
def evidence_register(spark: SparkSession, d: str) -> DataFrame:
    """Intake of three files, one working copy changed, one lost; only the untouched one opens."""
    at = _local(_folder(spark))
    reg = evidence.Register(str(at / "register"))
    items = []
    for n in "abc":
        (at / f"{n}.txt").write_text(n * 100)
        items.append(reg.intake(str(at / f"{n}.txt")))
    Path(items[1]["working"]).write_text("changed")
    Path(items[2]["working"]).unlink()
    rows = []
    for i in items:
        s = reg.status(i["evidence_id"])
        try:
            reg.open_for_analysis(i["evidence_id"])
            opens = True
        except ValueError:
            opens = False
        rows.append((i["name"], s["original"], s["working"], opens))
    return spark.createDataFrame(rows, "name string, original string, working string, opens boolean")


@query("SELECT * FROM (VALUES ('a.csv'), ('deep/b.json'), ('deep/c.db')) AS t(path)")
def src_listing(spark: SparkSession, d: str) -> DataFrame:
    """Readable files below a folder; hidden, technical and other files are left out."""
    at = _local(_folder(spark))
    for name in ("a.csv", "deep/b.json", "deep/c.db", "deep/notes.md", ".git/x.csv", "__pycache__/y.csv"):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("x")
    return spark.createDataFrame([(p,) for p in files.datasets(str(at))], "path string")


@query("SELECT CAST(10 AS BIGINT) AS kept, 'only the first 10 records are read' AS warning UNION ALL SELECT (SELECT count(*) FROM nation), NULL")
def src_rowcap(spark: SparkSession, d: str) -> DataFrame:
    """The cap is off unless it is asked for, and then says so."""
    t = table(spark, d, "nation")
    return spark.createDataFrame([(df.count(), w) for df, w in (files.row_cap(t, 10), files.row_cap(t))], "kept bigint, warning string")


@query("SELECT 'header 2, record 3' AS refused")
def src_malformed(spark: SparkSession, d: str) -> DataFrame:
    at = _local(_folder(spark))
    (at / "good.csv").write_text("a,b\n1,2\n")
    (at / "bad.csv").write_text("a,b\n1,2,3\n")
    files.check_fields(str(at / "good.csv"))
    try:
        files.check_fields(str(at / "bad.csv"))
        said = "nothing"
    except ValueError as e:
        said = "header 2, record 3" if "2 fields" in str(e) and "record 3" in str(e) else str(e)
    return spark.createDataFrame([(said,)], "refused string")


@query("SELECT 0 AS line, 'Regions' AS text UNION ALL SELECT 1, 'r_regionkey  r_name' UNION ALL SELECT 2 + r_regionkey, rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '  ' || r_name FROM region")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    text = sinks.text_report("Regions", table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")
