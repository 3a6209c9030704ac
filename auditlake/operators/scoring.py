"""Weighted counts, caps and bands over findings; set differences; comparison with a population mean.

Weights, caps and bands are parameters: the operators carry no business rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(c: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, w in weights.items():
        out = F.when(c == k, float(w)).otherwise(out)
    return out


def banded(c: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first band whose limit the value reaches; limits descending."""
    out = F.lit(otherwise)
    for limit, name in reversed(bands):
        out = F.when(c >= limit, name).otherwise(out)
    return out


def weighted_score(findings: DataFrame, by: list[str], level: str, weights: dict[str, float], default: float, cap: float, bands: list[tuple[float, str]], otherwise: str) -> DataFrame:
    """Findings, capped weighted score and band per group."""
    g = findings.groupBy(*by).agg(F.count("*").alias("findings"), F.least(F.sum(weight(F.col(level), weights, default)), F.lit(float(cap))).alias("score"))
    return g.select(*by, "findings", "score", banded(F.col("score"), bands, otherwise).alias("band"))


def combine(parts: dict[str, DataFrame], on: str) -> DataFrame:
    """Full outer join of per-entity counts; a part without the entity counts 0."""
    out = None
    for name, df in parts.items():
        p = df.select(on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != on])
        out = p if out is None else out.join(p, on, "full_outer")
    return out.na.fill(0)


def against_mean(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    """Adds mean_<c> and dev_<c>; the mean includes the row itself. One-row aggregate, no window over all rows."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    for c in columns:
        m = float(means[c] or 0.0)
        df = df.withColumn(f"mean_{c}", F.round(F.lit(m), places)).withColumn(f"dev_{c}", F.round(F.col(c) - F.lit(m), places))
    return df


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Competition rank over entity-sized frames."""
    return df.withColumn(name, F.rank().over(Window.orderBy(*order)).cast("bigint"))


def set_difference(df: DataFrame, key: str, expected: str, actual: str, sep: str) -> DataFrame:
    """(key, missing): one row per expected item that is not among the actual ones."""
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.explode(F.array_except(items(F.col(expected)), items(F.col(actual)))).alias("missing"))


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """Name of the first condition that holds."""
    out = F.lit(otherwise)
    for c, name in reversed(cases):
        out = F.when(c, name).otherwise(out)
    return out


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group in an order (a top-k report)."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("position") <= n)
