"""Filters, projections and paging over any DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Filter = tuple[str, str, Any]

OPS = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: c > F.lit(v),
    "ge": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "le": lambda c, v: c <= F.lit(v),
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
    "isnull": lambda c, v: c.isNull(),
    "notnull": lambda c, v: c.isNotNull(),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)) & (c != ""),
}


def condition(df: DataFrame, filters: Sequence[Filter]) -> Column:
    """Conjunction of filters; equality is null-safe, unknown columns and operators are errors."""
    for name, op, _ in filters:
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
        if op not in OPS:
            raise ValueError(f"unknown operator {op!r}")
    return reduce(lambda a, b: a & b, (OPS[op](F.col(n), v) for n, op, v in filters), F.lit(True))


def where(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return df.where(condition(df, filters))


def count_where(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """One row: matching rows and all rows."""
    return df.agg(F.count_if(condition(df, filters)).alias("matching"), F.count("*").alias("total"))


def project(df: DataFrame, columns: Sequence[str], order: str, limit: int = 100, offset: int = 0, filters: Sequence[Filter] = ()) -> DataFrame:
    """A page of rows in record order. The limit is the feature: a page, at most 10,000 rows."""
    if not 0 < limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1..10000 and offset not negative")
    return where(df, filters).select(order, *[c for c in columns if c != order]).orderBy(order).offset(offset).limit(limit)


def batches(df: DataFrame, columns: Sequence[str], order: str, size: int = 1000, filters: Sequence[Filter] = ()) -> Iterator[list[dict]]:
    """Rows in record order as lists of `size` dicts, one partition on the driver at a time."""
    part: list[dict] = []
    for row in where(df, filters).select(order, *[c for c in columns if c != order]).orderBy(order).toLocalIterator(prefetchPartitions=True):
        part.append(row.asDict())
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def scope_filter(df: DataFrame, entity: str | None = None, period: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of an entity and period, optionally between two ISO dates (nulls excluded)."""
    c = F.lit(True)
    c = c & (F.col("entity") == entity) if entity is not None else c
    c = c & (F.col("period") == period) if period is not None else c
    day = F.date_format("triggered_at", "yyyy-MM-dd")
    c = c & (day >= start) if start is not None else c
    c = c & (day <= end) if end is not None else c
    return df.where(c)


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Case-blind substring search over several columns together."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
