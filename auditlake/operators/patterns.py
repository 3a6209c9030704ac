"""Concentration: is the busiest group of a scope busier than an even spread would make likely?

The tail P(X >= k) of Bin(n, 1/groups) is taken per scope from the log-gamma function
and the ratio of neighbouring terms, starting at k and stopping where further terms
cannot change a double. One row per scope, no join, no window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import has_evidence, norm_value

SHIFT = 9  # Stirling's series is used from here on, where four terms reach 1e-13


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 1 + SHIFT, brought back by the product between."""
    x = n.cast("double") + 1.0
    y = x + float(SHIFT)
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return series - sum((F.ln(x + float(i)) for i in range(SHIFT)), F.lit(0.0))


def _log_term(n: Column, x: Column, p: Column) -> Column:
    return log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * F.ln(p) + (n - x) * F.ln(1.0 - p)


def _series(first: Column, steps: Column, ratio) -> Column:
    """1 + r1 + r1 r2 + ... over `steps` terms."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    add = lambda s, j: F.struct((s.term * ratio(first, j)).alias("term"), (s.sum + s.term * ratio(first, j)).alias("sum"))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), start, add, lambda s: s.sum)).otherwise(F.lit(1.0))


def log10_tail(n: Column, k: Column, groups: Column) -> Column:
    """log10 P(X >= k) for X ~ Bin(n, 1/groups): 0 where k <= 0, NULL where groups < 2, minus infinity where k > n.

    Above the mean the terms fall from k on; below it the complement is summed downwards
    instead. Either way 40 + 12 sqrt(n) terms are enough for a double.
    """
    n, k = n.cast("bigint"), k.cast("bigint")
    p = F.lit(1.0) / groups
    odds = p / (1.0 - p)
    enough = (F.lit(40.0) + 12.0 * F.sqrt(n.cast("double"))).cast("bigint")
    up = _log_term(n, k, p) + F.ln(_series(k, F.least(n - k, enough), lambda at, j: (n - at - j + 1) / (at + j) * odds))
    below = k - 1
    down = _log_term(n, below, p) + F.ln(_series(below, F.least(below, enough), lambda at, j: (at - j + 1) / (n - at + j) / odds))
    log_tail = F.when(k > n * p, up).otherwise(F.log1p(-F.least(F.exp(down), F.lit(1.0))))
    return F.when(groups >= 2, F.when(k <= 0, 0.0).when(k > n, float("-inf")).otherwise(F.least(F.lit(0.0), log_tail / math.log(10.0))))


def binomial_tail(df: DataFrame, n: str, k: str, groups: str) -> DataFrame:
    """Adds log10_tail."""
    return df.withColumn("log10_tail", log10_tail(F.col(n), F.col(k), F.col(groups)))


def concentration(df: DataFrame, concept: str, order: str, least_records: int = 12, least_groups: int = 3, least_busiest: int = 4, alpha: float = 0.01) -> DataFrame:
    """Per scope: records, groups, busiest group (ties: first to appear), tail probability and status.

    n counts all records of the scope, groups and the busiest only values with evidence.
    """
    keys = ["entity", "period"]
    # One count per (scope, value) with map-side combination serves all figures; the value without evidence is the NULL group.
    value = F.when(has_evidence(concept), norm_value(concept))
    g = df.groupBy(*keys, value.alias("g")).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    named = F.col("g").isNotNull()
    s = g.groupBy(*keys).agg(F.sum("c").alias("n_records"), F.max_by("g", F.when(named, F.struct(F.col("c"), -F.col("first")))).alias("busiest"), F.max(F.when(named, F.col("c"))).alias("k_busiest"), F.count("g").alias("n_groups")).where("n_groups > 0")
    s = binomial_tail(s, "n_records", "k_busiest", "n_groups")
    ok = (F.col("n_records") >= least_records) & (F.col("n_groups") >= least_groups) & (F.col("k_busiest") >= least_busiest)
    tail = F.pow(F.lit(10.0), F.col("log10_tail"))
    status = F.when(F.col("n_groups") < 2, "EVIDENCE_NOT_PRESENT").when(~ok, "NOT_EVALUABLE").when(tail <= alpha, "CONCENTRATION").otherwise("NO_CONCENTRATION")
    return s.select(*keys, "n_records", "n_groups", "busiest", "k_busiest", F.round("log10_tail", 6).alias("log10_tail"), status.alias("status"))


def group_positions(df: DataFrame, concept: str, value: str, order: str) -> DataFrame:
    """(entity, period, position): records of a scope that carry the named group."""
    return df.where(has_evidence(concept) & (norm_value(concept) == norm_value(F.lit(value)))).select("entity", "period", F.col(order).alias("position"))


METHODS = {"concentration": concentration}


def evaluate(method: str, df: DataFrame, **options) -> DataFrame:
    """Run a pattern method by its configured name; an unknown name is a configuration error."""
    if method not in METHODS:
        raise ValueError(f"unknown pattern method {method!r}")
    return METHODS[method](df, **options)
