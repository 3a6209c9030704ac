"""Rule engine: expectations and absences given as configuration, compiled to columns.

A rule is data. Conditions compare normalised tokens with `in` / `not_in`; a blank
value never matches. States are values, never missing: a rule without its evidence is
NOT_EVALUABLE rather than broken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import has_evidence, norm_value, rate

VIOLATED, SATISFIED, NOT_APPLICABLE, NOT_EVALUABLE = "EXPECTATION_VIOLATED", "EXPECTATION_SATISFIED", "NOT_APPLICABLE", "NOT_EVALUABLE"
COMPLETE, PARTIAL, NO_ABSENCE, NOT_TRIGGERED = "COMPLETE_ABSENCE", "PARTIAL_ABSENCE", "NO_ABSENCE", "EXPECTATION_NOT_TRIGGERED"


@dataclass(frozen=True)
class Condition:
    concept: str
    op: str
    values: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.op not in ("in", "not_in") or not self.values:
            raise ValueError(f"condition on {self.concept}: op must be in/not_in with values")

    def column(self) -> Column:
        n = norm_value(self.concept)
        return n.isin(list(self.values)) if self.op == "in" else (n != "") & ~n.isin(list(self.values))


@dataclass(frozen=True)
class GapRule:
    rule_id: str
    required: tuple[str, ...]
    violation: tuple[Condition, ...]
    expected: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class AbsenceRule:
    rule_id: str
    trigger: Condition
    expected_concepts: tuple[str, ...]
    usable: dict[str, tuple[str, ...]] = field(default_factory=dict)
    material_threshold: float | None = None


def validate(rules: list, columns: list[str]) -> None:
    """Unknown concepts and repeated ids are configuration errors."""
    ids = [r.rule_id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("rule ids must be unique")
    for r in rules:
        names = [*r.required, *(c.concept for c in (*r.violation, *r.expected))] if isinstance(r, GapRule) else [r.trigger.concept, *r.expected_concepts]
        if unknown := set(names) - set(columns):
            raise ValueError(f"{r.rule_id}: unknown concepts {sorted(unknown)}")


def _all(cs) -> Column:
    return reduce(lambda a, b: a & b, cs, F.lit(True))


def gap_state(rule: GapRule) -> Column:
    """State of one record under an expectation."""
    return (
        F.when(~_all(has_evidence(c) for c in rule.required), NOT_EVALUABLE)
        .when(_all(c.column() for c in rule.violation), VIOLATED)
        .when(_all(c.column() for c in rule.expected) if rule.expected else F.lit(False), SATISFIED)
        .otherwise(NOT_APPLICABLE)
    )


def gap_counts(df: DataFrame, rule: GapRule) -> DataFrame:
    """Records per scope and state, one row per scope."""
    s = df.withColumn("state", gap_state(rule))
    return s.groupBy("entity", "period").agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col("state") == v).alias(n) for n, v in (("violated", VIOLATED), ("satisfied", SATISFIED), ("not_applicable", NOT_APPLICABLE), ("not_evaluable", NOT_EVALUABLE))],
    )


def gap_findings(df: DataFrame, rule: GapRule, evidence: tuple[str, ...] = ()) -> DataFrame:
    """One finding per violating record, with its evidence as text."""
    cols = evidence or rule.required
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in cols])
    return df.where(gap_state(rule) == VIOLATED).select(F.lit(rule.rule_id).alias("rule_id"), F.lit("execution_gap").alias("family"), "entity", "period", "row_ordinal", text.alias("evidence"))


def _with_evidence(rule: AbsenceRule, concept: str) -> Column:
    """Evidence that states a usable outcome; submitted but unusable values count as without."""
    usable = rule.usable.get(concept)
    return has_evidence(concept) & (norm_value(concept).isin(list(usable)) if usable else F.lit(True))


def absence_measures(df: DataFrame, rule: AbsenceRule) -> DataFrame:
    """Per scope: triggered records, with and without the first expected concept, unusable ones among those without, coverage, state.

    The state is that of the first expected concept; `absence_coverage` has every one.
    """
    concept = rule.expected_concepts[0]
    with_ = _with_evidence(rule, concept)
    t = df.withColumn("_t", rule.trigger.column())
    m = t.groupBy("entity", "period").agg(
        F.count("*").alias("records"),
        F.count_if("_t").alias("triggered"),
        F.count_if(F.col("_t") & with_).alias("with_evidence"),
        F.count_if(F.col("_t") & ~with_).alias("without_evidence"),
        F.count_if(F.col("_t") & has_evidence(concept) & ~with_).alias("unusable"),
    )
    return m.select("*", rate(F.col("with_evidence"), F.col("triggered"), 4).alias("coverage"), _absence_state().alias("state"))


def _absence_state() -> Column:
    return F.when(F.col("triggered") == 0, NOT_TRIGGERED).when(F.col("with_evidence") == 0, COMPLETE).when(F.col("without_evidence") == 0, NO_ABSENCE).otherwise(PARTIAL)


def absence_coverage(df: DataFrame, rule: AbsenceRule) -> DataFrame:
    """(entity, period, concept, triggered, with, without, unusable, coverage, state) for every expected concept of a rule, in one pass."""
    t = df.withColumn("_t", rule.trigger.column())
    aggs, cells = [F.count_if("_t").alias("triggered")], []
    for i, c in enumerate(rule.expected_concepts):
        with_ = _with_evidence(rule, c)
        aggs += [F.count_if(F.col("_t") & with_).alias(f"w{i}"), F.count_if(F.col("_t") & ~with_).alias(f"o{i}"), F.count_if(F.col("_t") & has_evidence(c) & ~with_).alias(f"u{i}")]
        cells.append(F.struct(F.lit(c).alias("concept"), F.col(f"w{i}").alias("with_evidence"), F.col(f"o{i}").alias("without_evidence"), F.col(f"u{i}").alias("unusable")))
    m = t.groupBy("entity", "period").agg(*aggs).select("entity", "period", "triggered", F.explode(F.array(*cells)).alias("c")).select("entity", "period", "triggered", "c.*")
    return m.select("entity", "period", "concept", "triggered", "with_evidence", "without_evidence", "unusable", rate(F.col("with_evidence"), F.col("triggered"), 4).alias("coverage"), _absence_state().alias("state"))


def absence_positions(df: DataFrame, rule: AbsenceRule) -> DataFrame:
    """(entity, period, row_ordinal, unusable): triggered records without usable evidence of the first expected concept."""
    c = rule.expected_concepts[0]
    return df.where(rule.trigger.column() & ~_with_evidence(rule, c)).select("entity", "period", "row_ordinal", has_evidence(c).alias("unusable"))


def absence_findings(measures: DataFrame, rule: AbsenceRule) -> DataFrame:
    found = measures.where(F.col("state").isin(COMPLETE, PARTIAL))
    if rule.material_threshold is not None:
        found = found.where((F.col("state") == COMPLETE) | (F.col("without_evidence") >= rule.material_threshold * F.col("triggered")))
    status = F.when(F.col("state") == COMPLETE, "POTENTIAL_NEGATIVE_SPACE").otherwise("PARTIAL_NEGATIVE_SPACE")
    return found.select(F.lit(rule.rule_id).alias("rule_id"), F.lit("negative_space").alias("family"), "entity", "period", status.alias("status"), "triggered", "without_evidence", "coverage")


def state_counts(df: DataFrame, column: str = "state") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
