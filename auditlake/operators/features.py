"""Scope features for the anomaly model: nine aggregations, each NULL where its evidence is missing, never imputed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import has_evidence, norm_value, rate
from auditlake.operators import similarity

KEYS = ["entity", "period"]
# Order of the severity bands, lowest first.
BANDS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def ordinal(concept: str, bands: dict[str, int] = BANDS) -> Column:
    """Position of a value in an ordered vocabulary; NULL outside it."""
    n = norm_value(concept)
    c = F.lit(None).cast("int")
    for k, v in bands.items():
        c = F.when(n == k, v).otherwise(c)
    return c


def share_of(concept: str, target: tuple[str, ...], vocabulary: tuple[str, ...]) -> Column:
    """Share of `target` among values of `vocabulary`."""
    n = norm_value(concept)
    return rate(F.count_if(n.isin(list(target))), F.count_if(n.isin(list(vocabulary))))


def scope_features(df: DataFrame, severity: str = "severity", escalation: str = "escalation", group: str = "asset", concepts: tuple[str, ...] = ("severity", "escalation", "asset"), least: int = 1, text: str | None = None, order: str = "row_ordinal") -> DataFrame:
    """One row per scope. Plain aggregates share one pass; entropy and group share add a two-level one each.

    With a `text` concept the mean best-match similarity of its values is the ninth feature.
    Scopes below `least` records have every feature but the count NULL.
    """
    o = ordinal(severity)
    populated = [F.count_if(has_evidence(c)) for c in concepts]
    complete = F.lit(True)
    for p in populated:
        complete = complete & (p > 0)
    base = df.groupBy(*KEYS).agg(
        F.count("*").alias("scope_record_count"),
        share_of(severity, ("CRITICAL",), tuple(BANDS)).alias("critical_share"),
        F.round(F.avg(o) / max(BANDS.values()), 6).alias("mean_severity"),
        F.when(F.count_if(has_evidence(escalation)) > 0, rate(F.count_if(has_evidence(escalation)), F.count("*"))).alias("escalation_populated"),
        share_of(escalation, ("ESCALATED",), ("ESCALATED", "NOT_ESCALATED")).alias("escalated_share"),
        F.when(complete, F.round(sum(populated, F.lit(0)) / (F.count("*") * len(concepts)), 6)).alias("concept_coverage"),
    )
    out = base.join(entropy(df, severity), KEYS, "left").join(max_group_share(df, group), KEYS, "left")
    if text:
        out = out.join(mean_max_token_similarity(df, text, order), KEYS, "left")
    names = [c for c in out.columns if c not in (*KEYS, "scope_record_count")]
    return out.select(*KEYS, "scope_record_count", *[F.when(F.col("scope_record_count") >= least, F.col(c)).alias(c) for c in names])


def entropy(df: DataFrame, concept: str) -> DataFrame:
    """Shannon entropy of the in-vocabulary values over ln(number of bands)."""
    g = df.where(ordinal(concept).isNotNull()).groupBy(*KEYS, norm_value(concept).alias("v")).agg(F.count("*").alias("n"))
    t = g.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nl"))
    h = (F.ln("total") - F.col("nl") / F.col("total")) / F.lit(math.log(len(BANDS)))
    return t.select(*KEYS, F.abs(F.round(h, 6)).alias("severity_entropy"))


def max_group_share(df: DataFrame, concept: str) -> DataFrame:
    """Share of the busiest group among records with evidence of it."""
    g = df.where(has_evidence(concept)).groupBy(*KEYS, norm_value(concept).alias("v")).agg(F.count("*").alias("n"))
    return g.groupBy(*KEYS).agg(F.round(F.max("n") / F.sum("n"), 6).alias("max_group_share"))


def mean_max_token_similarity(df: DataFrame, text: str, order: str = "row_ordinal") -> DataFrame:
    """Mean best-match token similarity of a text's values with evidence; scopes with fewer than two have 0, with none are missing."""
    rows = similarity.token_rows(df.where(has_evidence(text)), KEYS, order, text)
    return similarity.mean_max_similarity(rows, KEYS).withColumnRenamed("mean_max_similarity", "mean_max_token_similarity")


def matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Complete rows only, as doubles in the order of `names`; a name the frame lacks or a repeated one is an error.

    A row with a missing or non-finite value is left out, never filled.
    """
    if unknown := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such features: {unknown}")
    if len(set(names)) != len(names):
        raise ValueError("feature names must be unique")
    ok = df
    for n in names:
        c = F.col(n).cast("double")
        ok = ok.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return ok.select(*KEYS, *[F.col(n).cast("double").alias(n) for n in names])


def concept_values(df: DataFrame, concept: str) -> DataFrame:
    """(entity, period, value): normalised values of a concept with evidence."""
    return df.where(has_evidence(concept)).select(*KEYS, norm_value(concept).alias("value"))
