"""Writing results: delimited text, JSON records with null fields kept, aggregate and full exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_KEYS = ["row_ordinal", "row_id", "evidence", "record"]  # fixed values: columns an aggregate export leaves out


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, so that JSON stays valid."""
    return df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _plain(c, kind: T.DataType):
    """A value JSON can hold, at every depth: no NaN or infinity, bytes as base64, times as ISO text."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | F.abs(c).isin(float("inf")), None).otherwise(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    return c


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Header, no index, missing columns and values blank."""
    for c in order or []:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df.select(*(order or df.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, null fields kept."""
    f = finite(df)
    f.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in f.columns]), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_aggregate(df: DataFrame, path: str) -> None:
    """Export without per-record columns."""
    write_json(df.select(*[c for c in df.columns if c not in RECORD_KEYS]), path)


def sections_report(sections: dict[str, DataFrame], limit: int = 50) -> str:
    """Several frames as one text, a section each."""
    return "\n\n".join(text_report(title, df, limit) for title, df in sections.items())


def text_report(title: str, df: DataFrame, limit: int = 50) -> str:
    """A small frame as aligned text (a report of its first rows)."""
    rows = [list(map(str, df.columns)), *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join([title, *["  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows]])
