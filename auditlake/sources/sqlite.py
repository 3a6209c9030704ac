"""SQLite as a Spark data source over the standard library, read-only, with rowid-range partitions."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from auditlake.session import ship_package
from auditlake.sources import files

# Words that no read-only statement may hold.
FORBIDDEN = ["insert", "update", "delete", "replace", "drop", "alter", "create", "attach", "detach", "pragma", "vacuum", "reindex", "analyze", "begin", "commit", "rollback", "savepoint", "release", "grant", "load_extension"]


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def guarded(query: str) -> str:
    """The statement if it is a single SELECT, WITH or VALUES without a writing word."""
    q = query.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "", q)
    if ";" in bare or not re.match(r"(?i)(select|with|values)\b", bare):
        raise ValueError("only one SELECT, WITH or VALUES statement is allowed")
    if bad := [w for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", bare)]:
        raise ValueError(f"statement holds {bad[0]!r}")
    return q


def only_table(path: str, table: str | None) -> str:
    with connect(path) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    if table is None and len(names) != 1:
        raise ValueError(f"name one of the tables {names}")
    if table is not None and table not in names:
        raise ValueError(f"no table {table!r}")
    return table or names[0]


class Slice(InputPartition):
    def __init__(self, sql: str) -> None:
        self.sql = sql


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, sql: str, table: str | None, parts: int) -> None:
        self.path, self.sql, self.table, self.parts = path, sql, table, parts

    def partitions(self) -> list[InputPartition]:
        if self.table is None or self.parts < 2:
            return [Slice(self.sql)]
        try:
            with connect(self.path) as c:
                lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        except sqlite3.OperationalError:  # a view or a table without rowid
            return [Slice(self.sql)]
        if lo is None:
            return [Slice(self.sql)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [Slice(f"{self.sql} WHERE rowid >= {a} AND rowid < {a + step}") for a in range(lo, hi + 1, step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with connect(self.path) as c:
            for row in c.execute(partition.sql):
                yield tuple(None if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in row)


class SqliteSource(DataSource):
    """Options: path, table or query, parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def _sql(self) -> tuple[str, str | None]:
        if q := self.options.get("query"):
            return guarded(q), None
        t = only_table(self.options["path"], self.options.get("table"))
        return f'SELECT * FROM "{t}"', t

    def schema(self) -> StructType:
        with connect(self.options["path"]) as c:
            cur = c.execute(f"SELECT * FROM ({self._sql()[0]}) LIMIT 0")
            return StructType([StructField(d[0], StringType()) for d in cur.description])

    def reader(self, schema: StructType) -> DataSourceReader:
        sql, t = self._sql()
        return SqliteReader(self.options["path"], sql, t, int(self.options.get("parts", "4")))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, parts: int = 4) -> DataFrame:
    """A table or guarded query; every column as text."""
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    r = spark.read.format("sqlite_ro").option("path", path).option("parts", str(parts))
    r = r.option("table", table) if table else r
    return (r.option("query", query) if query else r).load()


files.register("sqlite", read_sqlite)
