"""Read models over findings, capabilities, verdicts and benchmarks: what a screen or report asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "period"]


def unified_findings(families: dict[str, DataFrame]) -> DataFrame:
    """All families under one schema: family, entity, period, indicator, status, row_ordinal, evidence."""
    wanted = [("indicator", "rule_id"), ("status", None), ("row_ordinal", None), ("evidence", None)]
    parts = []
    for family, df in families.items():
        cols = [F.lit(family).alias("family"), *KEYS]
        for name, source in wanted:
            c = name if name in df.columns else source if source in df.columns else None
            kind = "bigint" if name == "row_ordinal" else "string"
            cols.append((F.col(c) if c else F.lit(None)).cast(kind).alias(name))
        parts.append(df.select(*cols))
    return reduce(DataFrame.unionByName, parts)


def family_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("family").agg(F.count("*").alias("n"))


def entity_rows(findings: DataFrame, scopes: DataFrame, families: list[str]) -> DataFrame:
    """Per scope: records, findings per family, total, and the leading family unless tied."""
    n = findings.groupBy(*KEYS).agg(*[F.count_if(F.col("family") == f).alias(f) for f in families])
    r = scopes.join(n, KEYS, "left").na.fill(0, families)
    top = F.greatest(*[F.col(f) for f in families]) if len(families) > 1 else F.col(families[0])
    leaders = F.array_compact(F.array(*[F.when((F.col(f) == top) & (top > 0), F.lit(f)) for f in families]))
    return r.select(*KEYS, "records", *families, sum((F.col(f) for f in families), F.lit(0)).cast("bigint").alias("signals"), F.when(F.size(leaders) == 1, leaders[0]).alias("leading_family"))


def ranked_entities(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("signals"), F.desc("records"), "entity", "period")


def options(scopes: DataFrame, column: str) -> DataFrame:
    return scopes.select(column).distinct().orderBy(column)


def capability_tally(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy(*KEYS, "status").agg(F.count("*").alias("n"))


def verdict_view(scored: DataFrame) -> DataFrame:
    return scored.groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def benchmark_matrix(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """Scopes by metrics, each cell the modified z."""
    return summaries.groupBy(*KEYS).pivot("metric", metrics).agg(F.first("modified_z"))


def comparable(summaries: DataFrame) -> DataFrame:
    """Benchmarks that place the target: a spread exists and the cohort is large enough."""
    return summaries.where("modified_z IS NOT NULL AND baseline <> 'UNAVAILABLE'")


def filter_findings(findings: DataFrame, family: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """Findings of a family and status whose indicator, evidence or entity contains a text in any letter case."""
    c = F.lit(True)
    c = c & (F.col("family") == family) if family else c
    c = c & (F.col("status") == status) if status else c
    c = c & F.contains(F.lower(F.concat_ws(" ", "indicator", "evidence", "entity")), F.lit(text.lower())) if text else c
    return findings.where(c)


def by_priority(rows: DataFrame, score: str, priority: str, left_out: str = "ROUTINE") -> DataFrame:
    """Rows by score, highest first, without those of the lowest priority."""
    return rows.where(F.col(priority) != left_out).orderBy(F.desc(score))


def report_rows(parts: dict[str, DataFrame], key: str = "entity") -> DataFrame:
    """Everything known of an entity in one row: the first part's entities, the others joined by the key itself, columns under their part's name."""
    out = None
    for name, df in parts.items():
        p = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = p if out is None else out.join(p, key, "left")
    return out


def available_features(scored: DataFrame, features: list[str]) -> DataFrame:
    """(entity, period, available): how many features a scope has."""
    return scored.select(*KEYS, sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0)).alias("available"))


def band_counts(rows: DataFrame, band: str) -> DataFrame:
    return rows.groupBy(band).agg(F.count("*").alias("n"))


def review_samples(findings: DataFrame, family_order: list[str], limit: int = 8) -> DataFrame:
    """The findings to read first: with a record, families in order, records named by several findings first (a top-k report)."""
    rank = F.lit(len(family_order))
    for i, f in reversed(list(enumerate(family_order))):
        rank = F.when(F.col("family") == f, i).otherwise(rank)
    w = Window.partitionBy("entity", "period", "row_ordinal")
    f = findings.withColumn("meeting", F.when(F.col("row_ordinal").isNotNull(), F.count("*").over(w)).otherwise(0))
    return f.orderBy(F.col("row_ordinal").isNull(), rank, F.desc("meeting"), "indicator", "entity", "period", "row_ordinal").limit(limit)
