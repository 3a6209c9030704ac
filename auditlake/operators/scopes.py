"""Assessment scopes: the (entity, period) a record belongs to.

Entities fall back from identifier to name to UNKNOWN_ENTITY. Periods come from an
explicit label; with exactly one label in the data, unlabelled rows inherit it; with
none, a period is derived from a timestamp as one range or as calendar buckets.
Global facts (how many labels, first and last day) are one-row aggregates taken once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import is_populated, strip
from auditlake.functions import dates

UNKNOWN_ENTITY, UNKNOWN_PERIOD = "UNKNOWN_ENTITY", "UNKNOWN_PERIOD"


def entity_key(*candidates: str) -> Column:
    """First populated candidate column, trimmed."""
    return F.coalesce(*[F.when(is_populated(c), strip(c)) for c in candidates], F.lit(UNKNOWN_ENTITY))


# Field names that name an entity outright, its part, or only an asset, in this order, with their confidence.
LEGACY = [(("entity_id", "entity", "organization", "organisation", "company", "cse_id", "tenant", "customer"), 1.0), (("department", "division", "business_unit", "region"), 0.7), (("asset_identifier", "host", "hostname", "device"), 0.3)]


def legacy_entity(df: DataFrame) -> Column:
    """struct(entity, confidence, source) from the field names of a record without mapping; the first that holds a value."""
    names = {c.lower(): c for c in reversed(df.columns)}
    found = [F.when(F.coalesce(F.col(names[f]).cast("string"), F.lit("")) != "", F.struct(F.col(names[f]).cast("string").alias("entity"), F.lit(conf).alias("confidence"), F.lit(f).alias("source"))) for fields, conf in LEGACY for f in fields if f in names]
    return F.coalesce(*found, F.struct(F.lit(UNKNOWN_ENTITY).alias("entity"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("source")))


def timestamp_pool(decisions: list) -> list[str]:
    """Columns a period may be derived from: mapped to a time, by confidence then name."""
    kinds = {"EVENT_TIMESTAMP", "TRIGGERED_AT", "ACKNOWLEDGED_AT", "CLOSED_AT", "WORKFLOW_EVENT_AT"}
    return [d.column for d in sorted((d for d in decisions if d.concept in kinds and d.confidence >= 0.45), key=lambda d: (-d.confidence, d.column))]


def with_period(df: DataFrame, label: str | None, timestamp: str | None = None, granularity: str = "range") -> DataFrame:
    """Adds `period`: explicit, inherited or derived."""
    explicit = F.when(is_populated(label), strip(label)) if label else F.lit(None).cast("string")
    df = df.withColumn("_label", explicit)
    if label:
        labels = df.agg(F.countDistinct("_label").alias("n"), F.min("_label").alias("one")).first()
        if labels.n:
            inherited = F.lit(labels.one) if labels.n == 1 else F.lit(UNKNOWN_PERIOD)
            return df.withColumn("period", F.coalesce("_label", inherited)).drop("_label")
    if not timestamp:
        return df.withColumn("period", F.lit(UNKNOWN_PERIOD)).drop("_label")
    t = F.col(timestamp) if dict(df.dtypes)[timestamp].startswith(("timestamp", "date")) else dates.parse_period(timestamp)
    if granularity != "range":
        return df.withColumn("period", F.coalesce(dates.bucket(t, granularity), F.lit(UNKNOWN_PERIOD))).drop("_label")
    ends = df.agg(F.date_format(F.min(t), "yyyy-MM-dd").alias("a"), F.date_format(F.max(t), "yyyy-MM-dd").alias("z")).first()
    return df.withColumn("period", F.when(t.isNotNull(), F.lit(f"{ends.a}..{ends.z}")).otherwise(UNKNOWN_PERIOD)).drop("_label")


def assessment_id() -> Column:
    return F.concat_ws("::", "entity", "period").alias("assessment_id")


def scope_counts(df: DataFrame) -> DataFrame:
    """Records per scope."""
    return df.groupBy("entity", "period").agg(F.count("*").alias("records"))


def scope_summary(df: DataFrame) -> DataFrame:
    """One row: scopes, entities and periods (unknown ones left out), unresolved rows."""
    s = scope_counts(df)
    return s.agg(
        F.count("*").alias("scopes"),
        F.countDistinct(F.when(F.col("entity") != UNKNOWN_ENTITY, F.col("entity"))).alias("entities"),
        F.countDistinct(F.when(F.col("period") != UNKNOWN_PERIOD, F.col("period"))).alias("periods"),
        F.coalesce(F.sum(F.when(F.col("entity") == UNKNOWN_ENTITY, F.col("records"))), F.lit(0)).alias("rows_without_entity"),
        F.sum("records").alias("records"),
    )
