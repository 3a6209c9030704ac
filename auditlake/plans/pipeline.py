"""The whole assessment over one source: read, profile, map, scope, evaluate, benchmark.

One driver round-trip decides the mapping (its size is that of the schema); everything
after is a lazy plan over one concept frame. A layer that lacks its evidence or fails is
reported as such with its reason and the others go on.
"""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import capability, features, forest, mapping, metrics, patterns, profile, robust, rules, scopes, similarity, views
from auditlake.sources import files, sqlite  # noqa: F401  registers its loader

AXES = [  # fixed values: what names the entity and period columns go by
    mapping.Pattern("ENTITY", "entity_context.entity_id", ("cse", "entity", "organisation", "operating_unit", "business_unit"), ("asset", "host"), (), (), "identifier"),
    mapping.Pattern("PERIOD", "entity_context.period", ("period", "reporting_window", "quarter", "month"), (), (), (r"(?i)^period", r"^\d{4}-(Q\d|\d\d)$"), "text"),
]
CAPABILITIES = capability.REGISTRY


def rules_from(config: dict[str, Any]) -> tuple[list[rules.GapRule], list[rules.AbsenceRule]]:
    """Rules from plain configuration: {"gaps": [...], "absences": [...]}."""
    cond = lambda c: rules.Condition(c["concept"], c.get("op", "in"), tuple(c["values"]))
    gaps = [rules.GapRule(r["id"], tuple(r["required"]), tuple(map(cond, r["violation"])), tuple(map(cond, r.get("expected", [])))) for r in config.get("gaps", [])]
    absences = [rules.AbsenceRule(r["id"], cond(r["trigger"]), tuple(r["expected"]), {k: tuple(v) for k, v in r.get("usable", {}).items()}, r.get("material_threshold")) for r in config.get("absences", [])]
    return gaps, absences


DEFAULT_RULES = {
    "gaps": [{"id": "critical_needs_escalation", "required": ["SECURITY_SEVERITY", "ESCALATION_STATUS"], "violation": [{"concept": "SECURITY_SEVERITY", "values": ["CRITICAL"]}, {"concept": "ESCALATION_STATUS", "values": ["NOT_ESCALATED"]}], "expected": [{"concept": "SECURITY_SEVERITY", "values": ["CRITICAL"]}, {"concept": "ESCALATION_STATUS", "values": ["ESCALATED"]}]}],
    "absences": [{"id": "critical_expects_decision", "trigger": {"concept": "SECURITY_SEVERITY", "values": ["CRITICAL"]}, "expected": ["ESCALATION_STATUS"], "usable": {"ESCALATION_STATUS": ["ESCALATED", "NOT_ESCALATED"]}}],
}


class Assessment:
    """Lazily evaluated layers over one frame of records."""

    def __init__(self, records: DataFrame, order: str | None = None, config: dict[str, Any] | None = None, overrides: dict[str, str] | None = None) -> None:
        self.spark = records.sparkSession
        self.records = records if order else files.with_ordinal(records)
        self.order = order or "row_ordinal"
        self.gaps, self.absences = rules_from(config or DEFAULT_RULES)
        self.overrides = overrides or {}

    @classmethod
    def of(cls, spark: SparkSession, path: str, **kw) -> Assessment:
        """From a file of any supported type."""
        return cls(files.load(spark, path), **kw)

    @cached_property
    def profile(self) -> list[dict]:
        return [r for r in profile.profile_rows(self.records, self.order) if r["column_name"] != self.order]

    @cached_property
    def decisions(self) -> list[mapping.Decision]:
        axes = {d.column for d in self.axes}
        ds = mapping.decide([r for r in self.profile if r["column_name"] not in axes])
        return mapping.override(ds, self.overrides)[0] if self.overrides else ds

    @cached_property
    def axes(self) -> list[mapping.Decision]:
        return [d for d in mapping.decide(self.profile, AXES) if d.applied]

    def package(self) -> dict[str, Any]:
        """What a preview shows: role, mapping report, decisions."""
        role, score = mapping.role(self.decisions)
        return {"role": role, "role_score": score, "mapping": mapping.report(self.decisions), "decisions": self.decisions, "columns": len(self.profile)}

    @cached_property
    def concepts(self) -> DataFrame:
        """row_ordinal, entity, period and every applied concept."""
        axis = {d.concept: d.column for d in self.axes}
        df = self.records
        applied = [d for d in self.decisions if d.applied]
        time = next((d.column for d in applied if d.concept == "EVENT_TIMESTAMP"), None)
        df = df.select(F.col(self.order).alias("row_ordinal"), *[F.col(d.column).cast("string").alias(d.concept) for d in applied], (scopes.entity_key(axis["ENTITY"]) if "ENTITY" in axis else F.lit(scopes.UNKNOWN_ENTITY)).alias("entity"), (F.col(axis["PERIOD"]).cast("string") if "PERIOD" in axis else F.lit(None).cast("string")).alias("_period"))
        return scopes.with_period(df, "_period", "EVENT_TIMESTAMP" if time else None).drop("_period")

    @cached_property
    def scopes(self) -> DataFrame:
        return scopes.scope_counts(self.concepts)

    def _usable(self, rule) -> bool:
        try:
            rules.validate([rule], self.concepts.columns)
        except ValueError:
            return False
        return True

    def gap_findings(self) -> DataFrame | None:
        parts = [rules.gap_findings(self.concepts, r) for r in self.gaps if self._usable(r)]
        return metrics.all_metrics(parts) if parts else None

    def absence_measures(self) -> DataFrame | None:
        parts = [rules.absence_measures(self.concepts, r).withColumn("rule_id", F.lit(r.rule_id)) for r in self.absences if self._usable(r)]
        return metrics.all_metrics(parts) if parts else None

    def absence_findings(self) -> DataFrame | None:
        parts = [rules.absence_findings(rules.absence_measures(self.concepts, r), r) for r in self.absences if self._usable(r)]
        return metrics.all_metrics(parts) if parts else None

    def capabilities(self) -> DataFrame:
        mapped = {d.concept: d.concept for d in self.decisions if d.applied}
        return capability.evaluate(capability.evidence_index(self.concepts, mapped, "row_ordinal"), self.scopes.select("entity", "period"), CAPABILITIES)

    def concentration(self, concept: str = "ASSET_IDENTIFIER") -> DataFrame | None:
        return patterns.concentration(self.concepts, concept, "row_ordinal") if concept in self.concepts.columns else None

    def repetition(self, concept: str = "INVESTIGATION_EVIDENCE") -> DataFrame | None:
        if concept not in self.concepts.columns:
            return None
        sets = similarity.token_sets(self.concepts, ["entity", "period"], "row_ordinal", concept)
        return similarity.repetition(sets, ["entity", "period"], 0.8, 12, 3)

    def metrics(self) -> DataFrame:
        """All scope metrics in long form."""
        parts = [metrics.capability_coverage(self.capabilities(), "evidence_coverage", [c.name for c in CAPABILITIES]), metrics.capability_coverage(self.capabilities(), "escalation_coverage", ["ESCALATION"])]
        if (g := self.gap_findings()) is not None:
            parts.append(metrics.flagged_incidence(self.scopes, g, "execution_gap_incidence"))
        if (a := self.absence_measures()) is not None:
            parts.append(metrics.absence_incidence(a))
        return metrics.all_metrics(parts)

    def benchmark(self) -> DataFrame:
        """Robust comparison of every scope and metric with the same period's other entities."""
        return robust.summaries(self.metrics().select("entity", "period", "metric", "rate"), ["period", "metric"], ["entity", "period", "metric"])

    def anomalies(self, trees: int = 100) -> DataFrame:
        """Verdict per scope; needs enough complete scopes to train on."""
        have = set(self.concepts.columns)
        df = self.concepts
        for c in ("SECURITY_SEVERITY", "ESCALATION_STATUS", "ASSET_IDENTIFIER"):
            if c not in have:
                df = df.withColumn(c, F.lit(None).cast("string"))
        f = features.scope_features(df, "SECURITY_SEVERITY", "ESCALATION_STATUS", "ASSET_IDENTIFIER", ("SECURITY_SEVERITY", "ESCALATION_STATUS", "ASSET_IDENTIFIER"))
        names = [c for c in f.columns if c not in ("entity", "period")]
        return forest.score(f, forest.train(f, names, ["entity", "period"], trees), names)

    def findings(self) -> DataFrame | None:
        parts = {k: v for k, v in (("execution_gap", self.gap_findings()), ("negative_space", self.absence_findings())) if v is not None}
        return views.unified_findings(parts) if parts else None

    def run(self) -> dict[str, Any]:
        """Every layer by name; a layer without its evidence is UNAVAILABLE with the reason, one with a defect FAILED with its error."""
        out: dict[str, Any] = {}
        layers = {"package": self.package, "scopes": lambda: self.scopes, "capabilities": self.capabilities, "findings": self.findings, "absences": self.absence_measures, "concentration": self.concentration, "repetition": self.repetition, "metrics": self.metrics, "benchmark": self.benchmark, "anomalies": self.anomalies}
        for name, f in layers.items():
            try:
                out[name] = f()
            except ValueError as e:
                out[name] = {"status": "UNAVAILABLE", "reason": str(e)[:300]}
            except Exception as e:  # noqa: BLE001  one layer's failure must not hide the others
                out[name] = {"status": "FAILED", "reason": f"{type(e).__name__}: {str(e)[:300]}"}
        return out
