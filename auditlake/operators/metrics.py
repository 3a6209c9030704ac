"""Scope metrics in long form: (entity, period, metric, numerator, denominator, rate, metric_status, reason).

A rate whose denominator is missing or zero is NULL with status NOT_EVALUABLE and a
reason; it is never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import rate

KEYS = ["entity", "period"]
COMPUTED, NOT_EVALUABLE = "COMPUTED", "NOT_EVALUABLE"


def _long(df: DataFrame, metric: str, num: Column, den: Column, why: str) -> DataFrame:
    ok = den.isNotNull() & (den > 0) & num.isNotNull()
    return df.select(
        *KEYS, F.lit(metric).alias("metric"), num.cast("bigint").alias("numerator"), den.cast("bigint").alias("denominator"), F.when(ok, rate(num, den)).alias("rate"),
        F.when(ok, COMPUTED).otherwise(NOT_EVALUABLE).alias("metric_status"), F.when(~ok, why).alias("reason"),
    )


def flagged_incidence(scopes: DataFrame, findings: DataFrame, metric: str) -> DataFrame:
    """Distinct flagged records over records; scopes hold `records`, findings `row_ordinal`."""
    f = findings.groupBy(*KEYS).agg(F.countDistinct("row_ordinal").alias("flagged"))
    return _long(scopes.join(f, KEYS, "left"), metric, F.coalesce("flagged", F.lit(0)), F.col("records"), "the scope holds no records")


def absence_incidence(measures: DataFrame) -> DataFrame:
    """Absent over triggered, summed over the expectations that were triggered."""
    m = measures.groupBy(*KEYS).agg(F.sum(F.when(F.col("triggered") > 0, F.col("without_evidence"))).alias("absent"), F.sum("triggered").alias("triggered"))
    return _long(m, "negative_space_incidence", F.col("absent"), F.col("triggered"), "no expectation was triggered in the scope")


def capability_coverage(evaluated: DataFrame, metric: str, capabilities: list[str]) -> DataFrame:
    """Available capabilities among those named."""
    c = evaluated.where(F.col("capability").isin(capabilities)).groupBy(*KEYS).agg(F.count_if(F.col("status") == "AVAILABLE").alias("have"), F.count("*").alias("of"))
    return _long(c, metric, F.col("have"), F.col("of"), "no capability of this kind is declared")


def anomaly_rate(scored: DataFrame) -> DataFrame:
    """One row over all scopes: anomalous over evaluated, the not evaluable apart."""
    s = scored.agg(F.count_if(F.col("verdict") == "POTENTIAL_OPERATIONAL_ANOMALY").alias("anomalous"), F.count_if(F.col("verdict") != "NOT_EVALUABLE").alias("evaluated"), F.count_if(F.col("verdict") == "NOT_EVALUABLE").alias("not_evaluable"))
    return s.select("*", rate(F.col("anomalous"), F.col("evaluated")).alias("rate"))


def all_metrics(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
