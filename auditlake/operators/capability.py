"""Capability coverage: which concepts are evidenced per scope, and what that makes assessable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.columns import is_populated

AVAILABLE, INSUFFICIENT, NOT_ASSESSED = "AVAILABLE", "INSUFFICIENT_EVIDENCE", "NOT_ASSESSED"


@dataclass(frozen=True)
class Capability:
    name: str
    primary: tuple[str, ...]
    supporting: tuple[str, ...]
    min_primary: int
    min_total: int


def evidence_index(df: DataFrame, concepts: dict[str, str], order: str) -> DataFrame:
    """(entity, period, concept, source_column, populated, example): one pass over the records, kept where populated.

    The example is the last populated value in record order.
    """
    aggs, cells = [], []
    for i, (concept, column) in enumerate(concepts.items()):
        ok = is_populated(column)
        aggs += [F.count_if(ok).alias(f"n{i}"), F.max_by(F.col(column).cast("string"), F.when(ok, F.col(order))).alias(f"x{i}")]
        cells.append(F.struct(F.lit(concept).alias("concept"), F.lit(column).alias("source_column"), F.col(f"n{i}").alias("populated"), F.col(f"x{i}").alias("example")))
    wide = df.groupBy("entity", "period").agg(*aggs)
    return wide.select("entity", "period", F.explode(F.array(*cells)).alias("c")).select("entity", "period", "c.*").where("populated > 0")


def evaluate(index: DataFrame, scopes: DataFrame, capabilities: list[Capability]) -> DataFrame:
    """(entity, period, capability, status, primary_hits, total_hits, coverage) for every scope and capability.

    The requirements are a literal list inside the plan, so nothing is joined to evaluate them.
    """
    have = scopes.join(index.groupBy("entity", "period").agg(F.collect_set("concept").alias("have")), ["entity", "period"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    cells = []
    for c in capabilities:
        hits = lambda names: F.size(F.array_intersect("have", F.array(*map(F.lit, names)))) if names else F.lit(0)
        p, t = hits(c.primary), hits((*c.primary, *c.supporting))
        status = F.when(p == 0, NOT_ASSESSED).when((p >= c.min_primary) & (t >= c.min_total), AVAILABLE).otherwise(INSUFFICIENT)
        cells.append(F.struct(F.lit(c.name).alias("capability"), status.alias("status"), p.cast("bigint").alias("primary_hits"), t.cast("bigint").alias("total_hits"), F.round(t / F.lit(len(c.primary) + len(c.supporting)), 4).alias("coverage")))
    return have.select("entity", "period", F.explode(F.array(*cells)).alias("c")).select("entity", "period", "c.*")


# The capabilities, their primary and supporting concepts (lower case: no concept carries them), least evidence.
REGISTRY = [
    Capability("THREAT_DETECTION", ("SECURITY_SEVERITY", "THREAT_CATEGORY", "SECURITY_LABEL"), ("EVENT_TIMESTAMP", "alert_id"), 2, 3),
    Capability("INVESTIGATION", ("INVESTIGATION_EVIDENCE",), ("root_cause", "evidence", "remediation", "USER_IDENTIFIER", "EVENT_TIMESTAMP"), 1, 2),
    Capability("ESCALATION", ("ESCALATION_STATUS",), ("SECURITY_SEVERITY", "acknowledged_at"), 1, 1),
    Capability("INCIDENT_RESPONSE", ("RESOLUTION_TIME",), ("containment", "remediation", "recovery", "EVENT_TIMESTAMP"), 1, 1),
    Capability("SECURITY_OPERATIONS", ("ASSET_IDENTIFIER",), ("telemetry", "coverage", "criticality", "EVENT_TIMESTAMP"), 1, 3),
    Capability("GOVERNANCE_OVERSIGHT", ("USER_IDENTIFIER",), ("remediation",), 1, 1),
    Capability("OPERATIONAL_DISCIPLINE", ("RESOLUTION_TIME", "SECURITY_SEVERITY"), ("INVESTIGATION_EVIDENCE", "EVENT_TIMESTAMP", "ESCALATION_STATUS"), 1, 3),
    Capability("CYBER_RESILIENCE", ("RESOLUTION_TIME",), ("EVENT_TIMESTAMP", "recovery", "continuity"), 1, 3),
]


def check_registry(capabilities: list[Capability], known: set[str]) -> list[str]:
    """What is wrong with a list of capabilities: repeated names, unknown concepts, evidence that can never suffice."""
    wrong = []
    names = [c.name for c in capabilities]
    wrong += [f"{n}: repeated" for n in sorted({n for n in names if names.count(n) > 1})]
    for c in capabilities:
        wrong += [f"{c.name}: unknown concept {x}" for x in (*c.primary, *c.supporting) if x.isupper() and x not in known]
        if not c.primary or not 1 <= c.min_primary <= len(c.primary) or not c.min_primary <= c.min_total <= len(c.primary) + len(c.supporting):
            wrong.append(f"{c.name}: its least evidence cannot be met")
    return wrong


def evaluate_dataset(index: DataFrame, capabilities: list[Capability]) -> DataFrame:
    """(capability, status, primary_hits, total_hits, coverage) over all scopes together."""
    whole = index.select(F.lit("*").alias("entity"), F.lit("*").alias("period"), "concept").distinct()
    return evaluate(whole, index.sparkSession.createDataFrame([("*", "*")], "entity string, period string"), capabilities).drop("entity", "period")


def summary(evaluated: DataFrame) -> DataFrame:
    """Scopes per capability and status."""
    return evaluated.groupBy("capability").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in (AVAILABLE, INSUFFICIENT, NOT_ASSESSED)])
