"""The concepts a source column can carry, where each goes in the canonical record, and what features need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Concept, canonical path, pipeline, kind of value, whether its pipeline requires it.
CONCEPTS = [
    ("SECURITY_SEVERITY", "alert_context.severity", "PIPELINE_1", "categorical", True),
    ("EVENT_TIMESTAMP", "alert_context.timestamp", "PIPELINE_1", "timestamp", False),
    ("THREAT_CATEGORY", "alert_context.category", "PIPELINE_1", "categorical", False),
    ("ALERT_ID", "alert_context.alert_id", "PIPELINE_1", "identifier", True),
    ("EVENT_ID", "alert_context.event_id", "PIPELINE_1", "identifier", False),
    ("TRIGGERED_AT", "alert_context.timestamp", "PIPELINE_1", "timestamp", True),
    ("ALERT_NAME", "alert_context.alert_name", "PIPELINE_1", "categorical", False),
    ("SOURCE_SYSTEM", "alert_context.source_system", "PIPELINE_1", "categorical", False),
    ("RESOLUTION_TIME", "response_context.resolution_time", "PIPELINE_2", "timestamp", False),
    ("INVESTIGATION_EVIDENCE", "investigation_context.notes", "PIPELINE_2", "text", False),
    ("ESCALATION_STATUS", "response_context.escalation_status", "PIPELINE_2", "categorical", False),
    ("CASE_ID", "case_context.case_id", "PIPELINE_2", "identifier", True),
    ("CASE_ALERT_ID", "case_context.alert_id", "PIPELINE_2", "identifier", False),
    ("ACKNOWLEDGED_AT", "case_context.acknowledged_at", "PIPELINE_2", "timestamp", False),
    ("CLOSED_AT", "case_context.closed_at", "PIPELINE_2", "timestamp", False),
    ("ANALYST_ID", "case_context.analyst_id", "PIPELINE_2", "identifier", False),
    ("ESCALATION_LEVEL", "case_context.escalation_level", "PIPELINE_2", "categorical", False),
    ("CLOSURE_DISPOSITION", "case_context.closure_disposition", "PIPELINE_2", "categorical", False),
    ("INVESTIGATION_NOTES", "case_context.investigation_notes", "PIPELINE_2", "text", False),
    ("WORKFLOW_CASE_ID", "workflow_context.case_id", "WORKFLOW", "identifier", True),
    ("WORKFLOW_EVENT_AT", "workflow_context.event_at", "WORKFLOW", "timestamp", False),
    ("WORKFLOW_EVENT_TYPE", "workflow_context.event_type", "WORKFLOW", "categorical", False),
    ("WORKFLOW_ACTOR", "workflow_context.actor", "WORKFLOW", "identifier", False),
    ("WORKFLOW_TIER", "workflow_context.tier", "WORKFLOW", "categorical", False),
    ("ASSET_CRITICALITY", "asset_context.criticality", "ASSET", "categorical", False),
    ("EXPECTED_TELEMETRY", "monitoring_context.expected_telemetry", "ASSET", "categorical", False),
    ("ASSET_IDENTIFIER", "asset_context.asset_id", "SHARED", "identifier", False),
    ("ASSET_TYPE", "asset_context.asset_type", "SHARED", "categorical", False),
    ("USER_IDENTIFIER", "entity_context.entity_name", "SHARED", "identifier", False),
    ("NETWORK_ZONE", "asset_context.network_zone", "SHARED", "categorical", False),
    ("SECURITY_LABEL", "classification_context.security_label", "SHARED", "categorical", False),
]
SECTIONS = ["entity_context", "alert_context", "investigation_context", "response_context", "case_context", "workflow_context", "asset_context", "monitoring_context", "network_context", "network_behavior_context", "application_context", "classification_context", "metadata"]  # fixed values
ROLE_PIPELINE = {"ALERTS": "PIPELINE_1", "CASES": "PIPELINE_2", "WORKFLOW_EVENTS": "WORKFLOW", "ASSETS": "ASSET"}  # fixed values
FEATURES = {  # fixed values: feature and the concepts it needs
    "FAST_CLOSURE_RISK": ("EVENT_TIMESTAMP", "RESOLUTION_TIME"),
    "SEVERITY_RISK": ("SECURITY_SEVERITY",),
    "INVESTIGATION_QUALITY": ("INVESTIGATION_EVIDENCE",),
    "ESCALATION_GAP": ("ESCALATION_STATUS", "SECURITY_SEVERITY"),
    "ASSET_CRITICALITY_RISK": ("ASSET_CRITICALITY",),
    "MONITORING_VISIBILITY_GAP": ("EXPECTED_TELEMETRY",),
}
PATHS = {c: p for c, p, *_ in CONCEPTS}


def for_pipeline(pipeline: str) -> list[str]:
    return [c for c, _, p, *_ in CONCEPTS if p in (pipeline, "SHARED")]


def required_for(role: str) -> list[str]:
    """Concepts a role requires; an unknown role requires none."""
    return [c for c, _, p, _, need in CONCEPTS if need and p == ROLE_PIPELINE.get(role)]


def missing_required(role: str, applied: list[str]) -> list[str]:
    """Required concepts whose place nothing fills (two concepts may share one place)."""
    filled = {PATHS[c] for c in applied if c in PATHS}
    return [c for c in required_for(role) if PATHS[c] not in filled]


def missing_sections(df: DataFrame) -> list[str]:
    """Canonical sections a nested frame lacks."""
    return [s for s in SECTIONS if s not in df.columns]


def concept_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPTS, "concept string, path string, pipeline string, kind string, required boolean")


def feature_availability(df: DataFrame, key: str, available: list[str]) -> DataFrame:
    """(key, feature, available, missing): per record, features whose concepts are all present.

    `available` names the concept columns of df; a concept without a column is missing for every record.
    """
    cells = []
    for name, needs in FEATURES.items():
        lack = F.array_compact(F.array(*[F.lit(c) if c not in available else F.when(F.col(c).isNull(), F.lit(c)) for c in needs]))
        cells.append(F.struct(F.lit(name).alias("feature"), (F.size(lack) == 0).alias("available"), F.concat_ws(",", lack).alias("missing")))
    return df.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def context(applied: list[str]) -> dict[str, float]:
    """What a dataset holds, as shares of the concepts that show it."""
    shows = {"alert_management": ("SECURITY_SEVERITY", "RESOLUTION_TIME"), "investigation": ("INVESTIGATION_EVIDENCE", "ESCALATION_STATUS"), "assets": ("ASSET_IDENTIFIER", "ASSET_CRITICALITY"), "network": ("NETWORK_ZONE",)}
    return {k: round(len(set(v) & set(applied)) / len(v), 2) for k, v in shows.items()}
