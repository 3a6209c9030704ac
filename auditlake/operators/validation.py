"""Validation issues as rows (code, severity, field, detail, n): one aggregation per check, counts always exact.

Fifteen codes exist. Two of them tell that a review was cut short at a bound; no review
here has a bound, so IDENTIFIER_REVIEW_TRUNCATED and VOCABULARY_REVIEW_TRUNCATED appear
only where a caller asks for a listing limit and it cuts something off. The other
thirteen come from `issues` (tables) and `mapping_issues` (decisions).

Defined results: a check whose columns are missing gives no row, a join whose key never
mapped gives JOIN_NOT_ASSESSABLE; an empty table gives no issue but that.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.columns import norm_id, strip
from auditlake.functions import dates, vocabulary
from auditlake.operators import concepts, profile, relations
from auditlake.session import ensure_checkpoint_dir

ERROR, WARNING, INFO = "error", "warning", "info"
LISTED, CONFLICTS = 25, 5  # fixed values: issues listed per check, conflicts per identifier
SCHEMA = "code string, severity string, field string, detail string, n bigint"


def _issue(df: DataFrame, code: str, level: str, field: str | None, detail=None) -> DataFrame:
    text = F.lit(None).cast("string") if detail is None else detail
    return df.select(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(field).cast("string").alias("field"), text.cast("string").alias("detail"), F.col("n").cast("bigint").alias("n"))


def duplicates(df: DataFrame, column: str, code: str, level: str) -> DataFrame:
    """Repeats of an identifier beyond its first row."""
    d = df.select(norm_id(column).alias("id")).where("id IS NOT NULL").groupBy("id").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n"))
    return _issue(d, code, level, column)


def unknown_values(df: DataFrame, column: str, vocab: str) -> DataFrame:
    """(value, n) of present values outside a vocabulary, trimmed."""
    return df.where(norm_id(column).isNotNull() & vocabulary.canonical(column, vocab).isNull()).groupBy(strip(column).alias("value")).agg(F.count("*").alias("n"))


def chronology_counts(df: DataFrame, triggered: str, acknowledged: str, closed: str) -> DataFrame:
    """(violation, n) over rows with the three times (timestamps)."""
    v = dates.chronology(F.col(triggered), F.col(acknowledged), F.col(closed))
    return df.select(F.explode(v).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def invalid_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n) of present texts no accepted format reads."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (dates.parsed(c)["parse_error"] & norm_id(c).isNotNull()).alias("bad")) for c in columns])).alias("c")).select("c.*")
    return cells.groupBy("field").agg(F.count_if("bad").alias("n"))


def listed(df: DataFrame, by: str, limit: int = LISTED) -> DataFrame:
    """The first rows of a check in order: a listing limit, counts beside it stay exact."""
    return df.orderBy(by).limit(limit)


def truncated(df: DataFrame, code: str, field: str, limit: int) -> DataFrame:
    """The note that a listing left something out, with how much."""
    return _issue(df.agg((F.count("*") - limit).alias("n")).where("n > 0"), code, INFO, field)


def _times(df: DataFrame, names: dict[str, str | None]) -> DataFrame:
    """Rows with triggered, acknowledged, closed as instants; a missing field is NULL."""
    kinds = dict(df.dtypes)

    def instant(c: str | None):
        if c is None:
            return F.lit(None).cast("timestamp")
        return F.col(c).cast("timestamp") if kinds[c].startswith(("timestamp", "date")) else dates.parse(c)

    return df.select(*[instant(c).alias(k) for k, c in names.items()])


def record_issues(df: DataFrame, role: str, fields: dict[str, str], limit: int = LISTED) -> DataFrame:
    """Value checks of one table: repeats, case conflicts, unknown severities, unreadable and impossible times.

    `fields` maps ALERT_ID, CASE_ID, WORKFLOW_CASE_ID, CASE_ALERT_ID, SECURITY_SEVERITY, TRIGGERED_AT (or
    EVENT_TIMESTAMP), ACKNOWLEDGED_AT, CLOSED_AT (or RESOLUTION_TIME) to columns. Repeats
    are errors in the table that owns the identifier, else warnings.
    """
    parts = []
    for concept, owner in (("ALERT_ID", "ALERTS"), ("CASE_ID", "CASES")):
        if c := fields.get(concept):
            parts.append(duplicates(df, c, f"DUPLICATE_{concept}", ERROR if role == owner else WARNING))
    for concept in ("ALERT_ID", "CASE_ID", "WORKFLOW_CASE_ID", "CASE_ALERT_ID"):
        if c := fields.get(concept):
            ids = df.select(norm_id(c).alias(c))
            first = profile.case_conflicts(ids, c).withColumn("detail", F.concat_ws(" / ", "kept", "other")).withColumn("n", F.lit(1))
            parts.append(_issue(listed(first, "detail", CONFLICTS), "CONFLICTING_IDENTIFIERS", ERROR, c, F.col("detail")))
            if limit != LISTED:
                parts.append(truncated(first, "IDENTIFIER_REVIEW_TRUNCATED", c, limit))
    if c := fields.get("SECURITY_SEVERITY"):
        unknown = unknown_values(df, c, "severity")
        parts.append(_issue(listed(unknown, "value", limit), "INVALID_SEVERITY", WARNING, c, F.col("value")))
        if limit != LISTED:
            parts.append(truncated(unknown, "VOCABULARY_REVIEW_TRUNCATED", c, limit))
    names = {"triggered": fields.get("TRIGGERED_AT") or fields.get("EVENT_TIMESTAMP"), "acknowledged": fields.get("ACKNOWLEDGED_AT"), "closed": fields.get("CLOSED_AT") or fields.get("RESOLUTION_TIME")}
    if used := [c for c in names.values() if c]:
        texts = [c for c in used if not dict(df.dtypes)[c].startswith(("timestamp", "date"))]  # a typed time was read already
        if texts:
            bad = invalid_timestamps(df, texts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            parts.append(_issue(bad, "INVALID_TIMESTAMP", WARNING, None))
        parts.append(_issue(chronology_counts(_times(df, names), *names), "IMPOSSIBLE_CHRONOLOGY", ERROR, None, F.col("violation")))
    return reduce(DataFrame.unionByName, parts).where("n > 0") if parts else df.sparkSession.createDataFrame([], SCHEMA)


def join_issues(alerts: DataFrame | None, cases: DataFrame | None, events: DataFrame | None = None, alert_col: str = "alert_id", case_col: str = "case_id", link_col: str | None = "alert_id", event_case: str | None = None) -> DataFrame:
    """Linkage checks between alerts, cases and workflow events; what has no key is not assessable, never clean."""
    some = next(x for x in (alerts, cases, events) if x is not None)
    spark, parts = some.sparkSession, []
    ensure_checkpoint_dir(spark)
    if alerts is None or cases is None or link_col is None:
        parts.append(_fixed(spark, "JOIN_NOT_ASSESSABLE", INFO, "alert/case"))
    else:
        facts = relations.summary(alerts, cases, alert_col, case_col, link_col).checkpoint()  # six rows, read three times
        for fact, code, level in (("orphan_cases", "ORPHAN_CASE", WARNING), ("unmatched_alerts", "UNMATCHED_ALERT", INFO), ("rows_without_alert_key", "MISSING_JOIN_KEY", WARNING)):
            parts.append(_issue(facts.where(F.col("fact") == fact), code, level, link_col))
    if events is not None and event_case is not None:
        if cases is None:
            parts.append(_fixed(spark, "JOIN_NOT_ASSESSABLE", INFO, "workflow/case"))
        else:
            lost = relations.orphan_events(relations.keys(events, event_case, "case_id"), relations.keys(cases, case_col, "case_id"))
            parts.append(_issue(lost.agg(F.count("*").alias("n")), "ORPHAN_WORKFLOW_EVENT", WARNING, event_case))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def _fixed(spark: SparkSession, code: str, level: str, detail: str | None, field: str | None = None) -> DataFrame:
    return spark.createDataFrame([(code, level, field, detail, 1)], SCHEMA)


def mapping_issues(spark: SparkSession, role: str, decisions: Iterable) -> DataFrame:
    """Required concepts no column carries, and columns that lost their place to another one."""
    decisions = list(decisions)
    rows = [("MISSING_REQUIRED_FIELD", WARNING, None, c, 1) for c in concepts.missing_required(role, [d.concept for d in decisions if d.applied])]
    holders = {d.path: d.column for d in decisions if d.applied}
    losers: dict[str, list[str]] = {}
    for d in decisions:
        if d.collided and d.path in holders:
            losers.setdefault(d.path, []).append(d.column)
    rows += [("MAPPING_COLLISION", WARNING, holders[p], f"{p}: {', '.join([holders[p], *names])}", len(names)) for p, names in sorted(losers.items())]
    return spark.createDataFrame(rows, SCHEMA)


def with_trigger(cases: DataFrame, alerts: DataFrame, link: str = "alert_id", alert_col: str = "alert_id", time: str = "alert_ts") -> DataFrame:
    """Cases with their alert's first time as `triggered_at`: one row per case row, alerts reduced to one per key first.

    Alerts without a time column leave it NULL.
    """
    if time not in alerts.columns:
        return cases.withColumn("triggered_at", F.lit(None).cast("timestamp"))
    first = alerts.select(norm_id(alert_col).alias("_k"), F.col(time).alias("_t")).where("_k IS NOT NULL").groupBy("_k").agg(F.min("_t").alias("triggered_at"))
    return cases.withColumn("_k", norm_id(link)).join(first, "_k", "left").drop("_k")


def issues(alerts: DataFrame, cases: DataFrame, events: DataFrame | None = None, event_case: str | None = None) -> DataFrame:
    """All issues of an alert and a case table, optionally with workflow events."""
    parts = [
        record_issues(alerts, "ALERTS", {"ALERT_ID": "alert_id", "SECURITY_SEVERITY": "severity"}),
        record_issues(with_trigger(cases, alerts), "CASES", {"CASE_ID": "case_id", "CASE_ALERT_ID": "alert_id", "TRIGGERED_AT": "triggered_at", "ACKNOWLEDGED_AT": "acknowledged_at", "CLOSED_AT": "closed_at"}),
        join_issues(alerts, cases, events, event_case=event_case),
    ]
    return reduce(DataFrame.unionByName, parts)


def rollup(found: DataFrame) -> DataFrame:
    """(code, issues, affected, errors, warnings): issues listed per code, what they cover, and the totals over all codes."""
    g = found.groupBy("code", "severity").agg(F.count("*").alias("issues"), F.sum("n").alias("affected"))
    w = Window.partitionBy()  # at most two levels of fifteen codes
    of = lambda level: F.sum(F.when(F.col("severity") == level, F.col("issues")).otherwise(0)).over(w)
    return g.select("code", "severity", "issues", "affected", of(ERROR).alias("errors"), of(WARNING).alias("warnings"))
