"""Reading submitted files: detection by extension and content, delimited text, JSON, NDJSON, SQLite, Parquet.

Only the head of a file is sniffed on the driver; the data is read by Spark. Blank
strings become NULL and a record ordinal can be attached in file order.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.columns import strip

# Extensions, and names of an envelope's record list.
EXTENSIONS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".parquet": "parquet"}
ENVELOPES = ["records", "data", "items", "results", "rows", "events"]
HEAD = 65_536

_LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register(kind: str, loader: Callable[..., DataFrame]) -> None:
    """Add or replace the loader of a source type: loader(spark, path, **options)."""
    _LOADERS[kind] = loader


def head(path: str, size: int = HEAD) -> bytes:
    p = Path(path.removeprefix("file://").removeprefix("file:"))
    if p.is_dir():
        p = next(iter(sorted(x for x in p.rglob("*") if x.is_file() and not x.name.startswith(("_", ".")))))
    with open(p, "rb") as f:
        return f.read(size)


def detect(path: str) -> str:
    """Source type; the content wins over the extension where they disagree."""
    by_name = EXTENSIONS.get(Path(path).suffix.lower())
    data = head(path)
    if data.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if data.startswith(b"PAR1"):
        return "parquet"
    text = data.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if lines and lines[0].startswith("{") and lines[0].endswith("}"):
        return "ndjson" if len(lines) > 1 or by_name == "ndjson" else by_name if by_name == "json" else "ndjson"
    if text[:1] in ("{", "["):
        return "json"
    return by_name if by_name in ("csv", None) and by_name else "csv"


def encoding(path: str) -> str:
    """utf-8 (a BOM is dropped by the reader), else cp1252, else latin-1, by the head of the file."""
    data = head(path)
    for name in ("utf-8", "cp1252"):
        try:
            data[: len(data) - 3 if len(data) == HEAD else None].decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def separator(path: str) -> str:
    first = head(path).split(b"\n", 1)[0]
    return "\t" if path.lower().endswith(".tsv") or (b"\t" in first and b"," not in first) else ","


def read_csv(spark: SparkSession, path: str, raw: bool = False, sep: str | None = None, malformed: str = "PERMISSIVE", multiline: bool | None = None) -> DataFrame:
    """Delimited text with a header; `raw` keeps every column as text."""
    e = encoding(path)
    r = spark.read.option("header", True).option("sep", sep or separator(path)).option("encoding", "utf-8" if e == "utf-8" else "ISO-8859-1").option("quote", '"').option("escape", '"').option("mode", malformed)
    # A file is split over tasks unless records may span lines; pass `multiline` where only later records do.
    multi = quoted_line_ends(path) if multiline is None else multiline
    df = r.option("multiLine", multi).option("inferSchema", not raw).csv(path)
    return _from_latin(df) if e == "cp1252" else df


def _from_latin(df: DataFrame) -> DataFrame:
    """cp1252 texts that were read as latin-1: the 0x80-0x9F range means other characters."""
    pairs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    old, new = "".join(k for k, v in pairs.items() if v), "".join(pairs.values())
    return df.select(*[(F.translate(f"`{n}`", old, new) if t == "string" else F.col(f"`{n}`")).alias(n.translate(str.maketrans(old, new))) for n, t in df.dtypes])


def read_ndjson(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """One object per line; a bad line is an error."""
    return spark.read.option("mode", "FAILFAST").option("primitivesAsString", raw).json(path)


def read_json(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """An array of objects, or an object whose record list is unpacked."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", raw).json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    name = next((n for n in ENVELOPES if n in lists), lists[0] if lists and len(df.schema.fields) <= len(lists) + 3 else None)
    return df.select(F.explode(name).alias("r")).select("r.*") if name else df


def normalise(df: DataFrame) -> DataFrame:
    """Blank texts and NaN to NULL, at every depth of structs and arrays."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _clean(c, kind: T.DataType):
    if isinstance(kind, T.StringType):
        return F.when(strip(c) != "", c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    return c


def open_pair(spark: SparkSession, path: str, kind: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The typed and the all-text view of one source."""
    kind = kind or detect(path)
    typed = load(spark, path, kind, **options)
    if kind in ("csv", "json", "ndjson"):
        return typed, load(spark, path, kind, raw=True, **options)
    return typed, typed.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in typed.columns])


def check_fields(path: str, sep: str | None = None) -> None:
    """An error where the first record has another number of fields than the header (small heads only)."""
    import csv
    import io

    data = head(path)
    if len(data) == HEAD:
        return
    rows = list(csv.reader(io.StringIO(data.decode(encoding(path), "replace")), delimiter=sep or separator(path)))
    if len(rows) > 1 and rows[1] and len(rows[0]) != len(rows[1]):
        raise ValueError(f"the header has {len(rows[0])} fields, the first record {len(rows[1])}")


def quoted_line_ends(path: str) -> bool:
    """Whether the head of a file shows a line end inside quotes."""
    data = head(path)
    return any(part.count(b'"') % 2 for part in data.split(b"\n")[:-1]) if b'"' in data else False


def with_ordinal(df: DataFrame, name: str = "row_ordinal") -> DataFrame:
    """Record position: consistent with file order inside a file, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def case_twins(df: DataFrame) -> list[str]:
    """Columns that differ from an earlier one only by case."""
    seen, out = set(), []
    for c in df.columns:
        out += [c] if c.lower() in seen else []
        seen.add(c.lower())
    return out


def load(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Records of a file of any supported type, blanks as NULL."""
    kind = kind or detect(path)
    if kind not in _LOADERS:
        raise ValueError(f"no loader for {kind!r}")
    return normalise(_LOADERS[kind](spark, path, **options))


SKIPPED = {"__pycache__", "node_modules", "venv", ".venv", ".git"}  # fixed values: folders that hold no submissions


def datasets(root: str, suffixes: tuple[str, ...] = tuple(EXTENSIONS)) -> list[str]:
    """Readable files below a folder by suffix, hidden and technical folders left out, as sorted relative paths."""
    base = Path(root.removeprefix("file://").removeprefix("file:"))
    found = (p for p in base.rglob("*") if p.is_file() and p.suffix.lower() in suffixes)
    return sorted(str(p.relative_to(base)) for p in found if not any(x in SKIPPED or x.startswith(".") for x in p.relative_to(base).parts))


def union(frames: list[DataFrame]) -> DataFrame:
    """All records under the union of the columns in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def row_cap(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, str | None]:
    """Optional cap on records with its warning; off unless a limit is given."""
    if limit is None:
        return df, None
    n = df.limit(limit + 1).count()
    return (df.limit(limit), f"only the first {limit} records are read") if n > limit else (df, None)


register("csv", read_csv)
register("json", read_json)
register("ndjson", read_ndjson)
register("parquet", lambda spark, path: spark.read.parquet(path))
