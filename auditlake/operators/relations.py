"""Relationships between alerts, cases and workflow events: linked, orphan, unmatched.

Keys are normalised and reduced to distinct ones before any join, so the joins move
keys, not records, and a hot key moves once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import norm_id


def keys(df: DataFrame, c: str, name: str) -> DataFrame:
    return df.select(norm_id(c).alias(name)).where(F.col(name).isNotNull()).distinct()


def case_links(cases: DataFrame, case_col: str, alert_col: str) -> DataFrame:
    """Distinct (case_id, alert_id) pairs with both keys present."""
    return cases.select(norm_id(case_col).alias("case_id"), norm_id(alert_col).alias("alert_id")).where("case_id IS NOT NULL AND alert_id IS NOT NULL").distinct()


def linked_cases(links: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases that name at least one known alert."""
    return links.join(alerts, "alert_id", "left_semi").select("case_id").distinct()


def orphan_cases(links: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases all of whose named alerts are unknown (a linked case is never an orphan)."""
    return links.join(alerts, "alert_id", "left_anti").select("case_id").distinct().join(linked_cases(links, alerts), "case_id", "left_anti")


def unmatched_alerts(links: DataFrame, alerts: DataFrame) -> DataFrame:
    return alerts.join(links, "alert_id", "left_anti")


def orphan_events(events: DataFrame, case_ids: DataFrame) -> DataFrame:
    """Workflow case keys that no case has."""
    return events.join(case_ids, "case_id", "left_anti")


def with_cases(alerts: DataFrame, cases: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Alerts with what their cases say; an alert without a case stays, one with several comes once per case."""
    return alerts.join(cases.select(key, *columns), key, "left")


def with_asset(records: DataFrame, assets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with their asset's columns; repeated asset rows count once (greatest values)."""
    one = assets.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
    return records.join(one, key, "left")


def flag_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether a row's key is among the members' keys."""
    return df.join(members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def summary(alerts: DataFrame, cases: DataFrame, alert_col: str = "alert_id", case_col: str = "case_id", link_col: str = "alert_id") -> DataFrame:
    """(fact, n): distinct alerts and cases, linked, orphan and unmatched, rows with a case but no alert key."""
    a = keys(alerts, alert_col, "alert_id").withColumn("known", F.lit(True))
    links = case_links(cases, case_col, link_col)
    # One outer join serves linked, orphan and unmatched: alerts without a case meet as the null case.
    met = links.join(a, "alert_id", "full_outer").groupBy("case_id").agg(F.max("known").alias("known"), F.count("*").alias("n"))
    named = F.col("case_id").isNotNull()
    joined = met.agg(F.count_if(named & F.col("known")).alias("linked_cases"), F.count_if(named & F.col("known").isNull()).alias("orphan_cases"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unmatched_alerts"))
    rows = cases.select(norm_id(case_col).alias("c"), norm_id(link_col).alias("l")).groupBy("c").agg(F.count_if(F.col("c").isNotNull() & F.col("l").isNull()).alias("n"))
    own = rows.agg(F.count("c").alias("cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_without_alert_key"))
    parts = [a.agg(F.count("*").alias("alerts")), own, joined]
    out = None
    for p in parts:
        cells = F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("bigint").alias("n")) for c in p.columns])
        r = p.select(F.explode(cells).alias("c")).select("c.*")
        out = r if out is None else out.unionByName(r)
    return out


def capped(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """One row: exact count, the first `limit` values in order, truncation flag."""
    first = df.orderBy(column).limit(limit).agg(F.array_sort(F.collect_list(column)).alias("first_values")).withColumn("k", F.lit(1))
    return df.agg(F.count("*").alias("n")).withColumn("k", F.lit(1)).join(first, "k").select("n", "first_values", (F.col("n") > limit).alias("truncated"))


def flag_count(name: str, c: Column) -> Column:
    return F.count_if(c).alias(name)
