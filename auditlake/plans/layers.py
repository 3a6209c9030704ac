"""Registered queries of the analytic layers with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.columns import norm_id, norm_value, tokens
from auditlake.functions import dates, vocabulary
from auditlake.operators import agreement, capability, features, filters, forest, integrity, mapping, patterns, profile, relations, robust, rules, scopes, scoring, similarity, validation
from auditlake.plans.records import RECORDS_SQL, records
from auditlake.session import ensure_checkpoint_dir, table
from auditlake.streaming import counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
REC = "WITH " + RECORDS_SQL


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


GAP = rules.GapRule("critical_needs_escalation", ("severity", "escalation"), (rules.Condition("severity", "in", ("CRITICAL",)), rules.Condition("escalation", "in", ("NOT_ESCALATED",))), (rules.Condition("severity", "in", ("CRITICAL",)), rules.Condition("escalation", "in", ("ESCALATED",))))
ABSENCE = rules.AbsenceRule("critical_expects_decision", rules.Condition("severity", "in", ("CRITICAL",)), ("escalation",), {"escalation": ("ESCALATED", "NOT_ESCALATED")})
STATE_SQL = "CASE WHEN severity IS NULL OR escalation IS NULL THEN 'NOT_EVALUABLE' WHEN severity = 'CRITICAL' AND escalation = 'NOT_ESCALATED' THEN 'EXPECTATION_VIOLATED' WHEN severity = 'CRITICAL' AND escalation = 'ESCALATED' THEN 'EXPECTATION_SATISFIED' ELSE 'NOT_APPLICABLE' END"
RATE_SQL = REC + f", g AS (SELECT entity, period, sector, count(*) AS records, count(*) FILTER (WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED') AS violated FROM rec GROUP BY ALL), m AS (SELECT entity, period, sector, round(violated / records, 6) AS rate FROM g)"


# --- expectations and absences -------------------------------------------------------


@query(REC + f" SELECT entity, period, count(*) AS records, count(*) FILTER (WHERE s = 'EXPECTATION_VIOLATED') AS violated, count(*) FILTER (WHERE s = 'EXPECTATION_SATISFIED') AS satisfied, count(*) FILTER (WHERE s = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (WHERE s = 'NOT_EVALUABLE') AS not_evaluable FROM (SELECT *, {STATE_SQL} AS s FROM rec) GROUP BY entity, period")
def gap_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return rules.gap_counts(records(spark, d), GAP)


@query(REC + f" SELECT {STATE_SQL} AS state, count(*) AS n FROM rec GROUP BY 1")
def gap_states(spark: SparkSession, d: str) -> DataFrame:
    return rules.state_counts(records(spark, d).withColumn("state", rules.gap_state(GAP)))


@query(REC + f" SELECT 'critical_needs_escalation' AS rule_id, 'execution_gap' AS family, entity, period, row_ordinal, 'severity=' || severity || '; escalation=' || escalation AS evidence FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED'")
def gap_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.gap_findings(records(spark, d), GAP)


ABS_SQL = REC + ", m AS (SELECT entity, period, count(*) AS records, count(*) FILTER (WHERE severity = 'CRITICAL') AS triggered, count(*) FILTER (WHERE severity = 'CRITICAL' AND escalation IN ('ESCALATED','NOT_ESCALATED')) AS with_evidence, count(*) FILTER (WHERE severity = 'CRITICAL' AND (escalation IS NULL OR escalation NOT IN ('ESCALATED','NOT_ESCALATED'))) AS without_evidence, count(*) FILTER (WHERE severity = 'CRITICAL' AND escalation = 'PENDING') AS unusable FROM rec GROUP BY entity, period), a AS (SELECT *, CASE WHEN triggered > 0 THEN round(with_evidence / triggered, 4) END AS coverage, CASE WHEN triggered = 0 THEN 'EXPECTATION_NOT_TRIGGERED' WHEN with_evidence = 0 THEN 'COMPLETE_ABSENCE' WHEN without_evidence = 0 THEN 'NO_ABSENCE' ELSE 'PARTIAL_ABSENCE' END AS state FROM m)"


@query(ABS_SQL + " SELECT * FROM a")
def absence_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return rules.absence_measures(records(spark, d), ABSENCE)


ABSENCE_ALL = rules.AbsenceRule("critical_expects_all", rules.Condition("severity", "in", ("CRITICAL",)), ("escalation", "segment"), {"escalation": ("ESCALATED", "NOT_ESCALATED"), "segment": ("BUILDING", "MACHINERY")})
_COV = "SELECT entity, period, '{c}' AS concept, count(*) FILTER (WHERE severity = 'CRITICAL') AS triggered, count(*) FILTER (WHERE severity = 'CRITICAL' AND coalesce({ok}, false)) AS with_evidence, count(*) FILTER (WHERE severity = 'CRITICAL' AND NOT coalesce({ok}, false)) AS without_evidence, count(*) FILTER (WHERE severity = 'CRITICAL' AND {c} IS NOT NULL AND NOT {ok}) AS unusable FROM rec GROUP BY entity, period"
COVERAGE = REC + ", m AS (" + _COV.format(c="escalation", ok="escalation IN ('ESCALATED','NOT_ESCALATED')") + " UNION ALL " + _COV.format(c="segment", ok="segment IN ('BUILDING','MACHINERY')") + ") SELECT *, CASE WHEN triggered > 0 THEN round(with_evidence / triggered, 4) END AS coverage, CASE WHEN triggered = 0 THEN 'EXPECTATION_NOT_TRIGGERED' WHEN with_evidence = 0 THEN 'COMPLETE_ABSENCE' WHEN without_evidence = 0 THEN 'NO_ABSENCE' ELSE 'PARTIAL_ABSENCE' END AS state FROM m"


@query(COVERAGE)
def absence_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.absence_coverage(records(spark, d), ABSENCE_ALL)


@query(REC + " SELECT entity, period, row_ordinal, escalation IS NOT NULL AS unusable FROM rec WHERE severity = 'CRITICAL' AND coalesce(escalation NOT IN ('ESCALATED','NOT_ESCALATED'), true)")
def absence_positions(spark: SparkSession, d: str) -> DataFrame:
    return rules.absence_positions(records(spark, d), ABSENCE)


@query(ABS_SQL + " SELECT state, count(*) AS n FROM a GROUP BY state")
def absence_states(spark: SparkSession, d: str) -> DataFrame:
    return rules.state_counts(rules.absence_measures(records(spark, d), ABSENCE))


@query(ABS_SQL + " SELECT 'critical_expects_decision' AS rule_id, 'negative_space' AS family, entity, period, CASE state WHEN 'COMPLETE_ABSENCE' THEN 'POTENTIAL_NEGATIVE_SPACE' ELSE 'PARTIAL_NEGATIVE_SPACE' END AS status, triggered, without_evidence, coverage FROM a WHERE state IN ('COMPLETE_ABSENCE','PARTIAL_ABSENCE')")
def absence_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.absence_findings(rules.absence_measures(records(spark, d), ABSENCE), ABSENCE)


@query(REC + ", f AS (SELECT entity, count(*) AS findings, least(sum(CASE severity WHEN 'CRITICAL' THEN 0.25 WHEN 'HIGH' THEN 0.15 ELSE 0.05 END), 100.0) AS score FROM rec GROUP BY entity) SELECT entity, findings, round(score, 6) AS score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band, rank() OVER (ORDER BY round(score, 6) DESC, findings DESC) AS rank FROM f")
def attention_rank(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.weighted_score(records(spark, d), ["entity"], "severity", {"CRITICAL": 0.25, "HIGH": 0.15}, 0.05, 100.0, [(70, "HIGH"), (40, "MEDIUM")], "LOW").withColumn("score", F.round("score", 6))
    return scoring.ranked(s, [F.desc("score"), F.desc("findings")])


# --- scopes and periods ----------------------------------------------------------------


@query(REC + ", s AS (SELECT entity, period, count(*) AS records FROM rec GROUP BY ALL) SELECT count(*) AS scopes, count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods, CAST(coalesce(sum(CASE WHEN entity = 'UNKNOWN_ENTITY' THEN records END), 0) AS BIGINT) AS rows_without_entity, CAST(sum(records) AS BIGINT) AS records FROM s")
def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    return scopes.scope_summary(records(spark, d))


@query("SELECT coalesce(CASE WHEN lower(trim(cse)) NOT IN ('','nan','nat','none','null') THEN trim(cse) END, 'UNKNOWN_ENTITY') AS entity, coalesce(CASE WHEN lower(trim(period)) NOT IN ('','nan','nat','none','null') THEN trim(period) END, 'UNKNOWN_PERIOD') AS period, count(*) AS records FROM dataset_multi_cse GROUP BY 1, 2")
def scope_records(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dataset_multi_cse").withColumn("entity", scopes.entity_key("cse"))
    return scopes.scope_counts(scopes.with_period(df, "period"))


@query("SELECT strftime(alert_ts, '%Y-%m') AS period, count(*) AS records FROM alert_context GROUP BY 1")
def period_buckets(spark: SparkSession, d: str) -> DataFrame:
    df = scopes.with_period(table(spark, d, "alert_context"), None, "alert_ts", "month")
    return df.groupBy("period").agg(F.count("*").alias("records"))


@query("SELECT (SELECT strftime(min(ts), '%Y-%m-%d') || '..' || strftime(max(ts), '%Y-%m-%d') FROM events) AS period, count(*) AS records FROM events")
def period_range(spark: SparkSession, d: str) -> DataFrame:
    return scopes.with_period(table(spark, d, "events"), None, "ts").groupBy("period").agg(F.count("*").alias("records"))


@query(REC + " SELECT row_ordinal, severity FROM rec WHERE entity = 'NATION_3' AND strftime(triggered_at, '%Y-%m-%d') >= '1996-01-01' AND strftime(triggered_at, '%Y-%m-%d') <= '1997-12-31'")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.scope_filter(records(spark, d), "NATION_3", None, "1996-01-01", "1997-12-31").select("row_ordinal", "severity")


# --- profiles and filters ------------------------------------------------------------


def _num_sql(t: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, 'numeric' AS kind, count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS null_values, count(*) AS total_rows, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(coalesce(stddev_samp(CAST({c} AS DOUBLE)), 0), 4) AS std FROM {t}" for c in cols)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_num_sql("lineitem", LINE_COLUMNS))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(table(spark, d, "lineitem"), LINE_COLUMNS)


TEXT_COLUMNS = ["cse", "period", "alert_id", "priority", "threat_type", "host", "closed_by", "telemetry_available", "escalation_status"]
_NA = "'" + "','".join(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]) + "'"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT CASE WHEN {c} NOT IN ({_NA}) THEN {c} END) AS unique_values, count(*) FILTER (WHERE {c} IS NULL OR {c} IN ({_NA})) AS null_values, count(*) AS total_rows FROM dataset_capability_rich" for c in TEXT_COLUMNS))
def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(table(spark, d, "dataset_capability_rich"), TEXT_COLUMNS).select("column_name", "unique_values", "null_values", "total_rows")


@query("SELECT o_orderpriority AS value, min(o_orderkey) AS first_row FROM orders GROUP BY 1 ORDER BY 2 LIMIT 10")
def profile_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return profile.appearance_samples(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 10)


@query("SELECT alert_id AS value, count(*) AS n FROM alert_context WHERE alert_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_values(table(spark, d, "alert_context"), "alert_id")


@query("SELECT severity AS value, count(*) AS n FROM alert_context WHERE severity IS NOT NULL GROUP BY 1")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_values(table(spark, d, "alert_context"), "severity")


@query("WITH i AS (SELECT DISTINCT trim(alert_id) AS id FROM case_context WHERE alert_id IS NOT NULL), g AS (SELECT lower(id) AS key, min(id) AS kept FROM i GROUP BY 1 HAVING count(*) > 1) SELECT key, kept, id AS other FROM i JOIN g ON lower(id) = key WHERE id <> kept")
def case_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return profile.case_conflicts(table(spark, d, "case_context"), "alert_id")


@query("SELECT count(*) FILTER (WHERE severity IS NOT DISTINCT FROM 'HIGH' AND category IS DISTINCT FROM 'phishing') AS matching, count(*) AS total FROM alert_context")
def filter_null_safe(spark: SparkSession, d: str) -> DataFrame:
    return filters.count_where(table(spark, d, "alert_context"), [("severity", "eq", "HIGH"), ("category", "ne", "phishing")])


@query("SELECT row_id, alert_name FROM alert_context WHERE contains(alert_name, 'or') AND deleted_at IS NOT NULL")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return filters.where(table(spark, d, "alert_context"), [("alert_name", "contains", "or"), ("deleted_at", "notnull", None)]).select("row_id", "alert_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_tax <= 0.02 AND l_extendedprice > 90000")
def filter_ranges(spark: SparkSession, d: str) -> DataFrame:
    return filters.where(table(spark, d, "lineitem"), [("l_quantity", "ge", 45), ("l_discount", "lt", 0.03), ("l_tax", "le", 0.02), ("l_extendedprice", "gt", 90000)]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 25")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.project(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 50, 25, [("o_orderstatus", "eq", "F")])


@query("SELECT alert_name || ' ' || coalesce(category, '') AS text, count(*) AS n FROM alert_context WHERE contains(lower(concat_ws(' ', alert_name, category)), 'growth') GROUP BY 1")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    s = filters.search(table(spark, d, "alert_context"), ["alert_name", "category"], "GROWTH")
    return s.groupBy(F.concat("alert_name", F.lit(" "), F.coalesce("category", F.lit(""))).alias("text")).agg(F.count("*").alias("n"))


# --- scalar functions ----------------------------------------------------------------


@query(r"SELECT coalesce(regexp_replace(upper(regexp_replace(regexp_replace(trim(escalation_status, ' '), '[ .\-/]', '_', 'g'), '_+', '_', 'g')), '^_+|_+$', '', 'g'), '') AS token, count(*) AS n FROM dataset_capability_rich GROUP BY 1")
def norm_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_capability_rich").groupBy(norm_value("escalation_status").alias("token")).agg(F.count("*").alias("n"))


@query(r"SELECT CASE WHEN lower(regexp_replace(alert_id, '^\s+|\s+$', '', 'g')) NOT IN ('','nan','nat','none','null','n/a','-') THEN regexp_replace(alert_id, '^\s+|\s+$', '', 'g') END AS id, count(*) AS n FROM dataset_multi_cse GROUP BY 1")
def norm_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_multi_cse").groupBy(norm_id("alert_id").alias("id")).agg(F.count("*").alias("n"))


@query(r"WITH t AS (SELECT row_id, list_sort(list_distinct(regexp_extract_all(lower(investigation_notes), '[a-z0-9]+'))) AS w FROM dataset_multi_cse WHERE investigation_notes IS NOT NULL) SELECT row_id, array_to_string(w, ' ') AS words, CAST(len(w) AS INTEGER) AS n_words FROM t WHERE len(w) > 0")
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_multi_cse").select("row_id", tokens("investigation_notes").alias("w")).where("w IS NOT NULL")
    return t.select("row_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n_words"))


# The vocabularies as the SQL side knows them, written out.
_SEVERITY_SQL = "CASE {k} WHEN 'critical' THEN 'CRITICAL' WHEN 'crit' THEN 'CRITICAL' WHEN 'sev1' THEN 'CRITICAL' WHEN 'sev-1' THEN 'CRITICAL' WHEN 'sev 1' THEN 'CRITICAL' WHEN 'p1' THEN 'CRITICAL' WHEN 's1' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'sev2' THEN 'HIGH' WHEN 'sev-2' THEN 'HIGH' WHEN 'sev 2' THEN 'HIGH' WHEN 'p2' THEN 'HIGH' WHEN 's2' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' WHEN 'med' THEN 'MEDIUM' WHEN 'moderate' THEN 'MEDIUM' WHEN 'sev3' THEN 'MEDIUM' WHEN 'sev-3' THEN 'MEDIUM' WHEN 'sev 3' THEN 'MEDIUM' WHEN 'p3' THEN 'MEDIUM' WHEN 's3' THEN 'MEDIUM' WHEN 'low' THEN 'LOW' WHEN 'sev4' THEN 'LOW' WHEN 'sev-4' THEN 'LOW' WHEN 'sev 4' THEN 'LOW' WHEN 'p4' THEN 'LOW' WHEN 's4' THEN 'LOW' WHEN 'info' THEN 'LOW' WHEN 'informational' THEN 'LOW' END"
_ESCALATION_SQL = "CASE {k} WHEN 'escalated' THEN 'ESCALATED' WHEN 'yes' THEN 'ESCALATED' WHEN 'y' THEN 'ESCALATED' WHEN 'true' THEN 'ESCALATED' WHEN 'escalate' THEN 'ESCALATED' WHEN 'not_escalated' THEN 'NOT_ESCALATED' WHEN 'not escalated' THEN 'NOT_ESCALATED' WHEN 'no' THEN 'NOT_ESCALATED' WHEN 'n' THEN 'NOT_ESCALATED' WHEN 'false' THEN 'NOT_ESCALATED' WHEN 'pending' THEN 'PENDING' WHEN 'requested' THEN 'PENDING' END"
_DISPOSITION_SQL = "CASE {k} WHEN 'closed' THEN 'CLOSED' WHEN 'resolved' THEN 'CLOSED' WHEN 'fixed' THEN 'CLOSED' WHEN 'completed' THEN 'CLOSED' WHEN 'done' THEN 'CLOSED' WHEN 'false_positive' THEN 'FALSE_POSITIVE' WHEN 'false positive' THEN 'FALSE_POSITIVE' WHEN 'fp' THEN 'FALSE_POSITIVE' WHEN 'benign' THEN 'FALSE_POSITIVE' WHEN 'duplicate' THEN 'DUPLICATE' WHEN 'dup' THEN 'DUPLICATE' WHEN 'wont_fix' THEN 'WONT_FIX' WHEN 'won''t fix' THEN 'WONT_FIX' WHEN 'wont fix' THEN 'WONT_FIX' WHEN 'deferred' THEN 'WONT_FIX' WHEN 'open' THEN 'OPEN' WHEN 'reopened' THEN 'OPEN' WHEN 're-opened' THEN 'OPEN' WHEN 'in_progress' THEN 'OPEN' WHEN 'in progress' THEN 'OPEN' END"
_TRIMMED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _word_sql(sql: str, c: str) -> str:
    return sql.replace("{k}", f"lower({_TRIMMED.format(c=c)})")


def _vocab_sql(t: str, c: str, sql: str) -> str:
    return f"WITH x AS (SELECT {c} AS original, CASE WHEN lower({_TRIMMED.format(c=c)}) NOT IN ('','nan','nat','none','null','n/a','-','unknown') THEN {_word_sql(sql, c)} END AS canonical FROM {t}) SELECT original, canonical, canonical IS NOT NULL AS known, count(*) AS n FROM x GROUP BY ALL"


def _vocab(df: DataFrame, c: str, v: str) -> DataFrame:
    return df.select(vocabulary.normalised(c, v).alias("v")).groupBy(F.col("v.original"), F.col("v.canonical"), F.col("v.known")).agg(F.count("*").alias("n"))


@query(_vocab_sql("alert_context", "severity", _SEVERITY_SQL))
def norm_severity(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(table(spark, d, "alert_context"), "severity", "severity")


@query(_vocab_sql("dataset_capability_rich", "priority", _SEVERITY_SQL))
def norm_priority(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(table(spark, d, "dataset_capability_rich"), "priority", "severity")


@query(_vocab_sql("dataset_capability_rich", "escalation_status", _ESCALATION_SQL))
def norm_escalation(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(table(spark, d, "dataset_capability_rich"), "escalation_status", "escalation")


@query(_vocab_sql("case_context", "closure_disposition", _DISPOSITION_SQL))
def norm_disposition(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(table(spark, d, "case_context"), "closure_disposition", "disposition")


# What single spellings mean, by the vocabularies' definition.
SPELLINGS = [
    ("severity", "S1", "CRITICAL"), ("severity", " sev-2 ", "HIGH"), ("severity", "s3", "MEDIUM"), ("severity", "INFO", "LOW"), ("severity", "Informational", "LOW"), ("severity", "URGENT", None), ("severity", "1", None),
    ("escalation", "ESCALATE", "ESCALATED"), ("escalation", "not escalated", "NOT_ESCALATED"), ("escalation", "none", None), ("escalation", "Requested", "PENDING"), ("escalation", "L2", None),
    ("disposition", "DEFERRED", "WONT_FIX"), ("disposition", "won't fix", "WONT_FIX"), ("disposition", "Re-opened", "OPEN"), ("disposition", "Benign", "FALSE_POSITIVE"), ("disposition", "merged", None),
]


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in SPELLINGS) + ") AS t(vocabulary, spelling, canonical)")
def vocab_spellings(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([r[:2] for r in SPELLINGS], "vocabulary string, spelling string")
    return t.withColumn("canonical", F.coalesce(*[F.when(F.col("vocabulary") == v, vocabulary.canonical("spelling", v)) for v in vocabulary.VOCABULARIES]))


@query(f"SELECT row_id, CASE WHEN lower({_TRIMMED.format(c='priority')}) NOT IN ('','nan','nat','none','null','n/a','-','unknown') THEN {_word_sql(_SEVERITY_SQL, 'priority')} END AS severity_canonical, CASE WHEN lower({_TRIMMED.format(c='escalation_status')}) NOT IN ('','nan','nat','none','null','n/a','-','unknown') THEN {_word_sql(_ESCALATION_SQL, 'escalation_status')} END AS escalation_canonical FROM dataset_capability_rich")
def vocab_record(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.record(table(spark, d, "dataset_capability_rich"), severity="priority", escalation="escalation_status").select("row_id", "severity_canonical", "escalation_canonical")


# Texts with and without a zone in the accepted formats, and their instant.
INSTANTS = [
    ("12-Jan-2026", "2026-01-12 00:00:00", None), ("12-jan-2026 10:11:12", "2026-01-12 10:11:12", None), ("2026-01-12T10:11", "2026-01-12 10:11:00", "2026-01-12 10:11:00"), ("2026-01-12T10:11:12+02:00", "2026-01-12 08:11:12", "2026-01-12 08:11:12"), ("2026-01-12T10:11:12.5Z", "2026-01-12 10:11:12", "2026-01-12 10:11:12"),
    ("03/04/2026", "2026-04-03 00:00:00", "2026-04-03 00:00:00"), ("04/13/2026", "2026-04-13 00:00:00", None), ("2026/01/02 03:04:05", "2026-01-02 03:04:05", None), ("12-01-2026", None, "2026-01-12 00:00:00"), ("01.02.2026", None, None), ("3/4/2026 10:11", None, None), ("2026-02-30", None, None), ("n/a", None, None), ("1759280138", None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in INSTANTS) + ") AS t(written, instant, period_instant)")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([r[:1] for r in INSTANTS], "written string")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.select("written", shown(dates.parse("written")).alias("instant"), shown(dates.parse_period("written")).alias("period_instant"))


_ISO_T = r"regexp_full_match(t, '\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d([.,]\d{1,9})?)?)?([+-]\d\d(:?\d\d)?|[Zz])?)?')"
_SHIFT = r"(CASE WHEN z ~ '^[+-]' THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CASE WHEN length(z) > 3 THEN CAST(right(z, 2) AS INTEGER) ELSE 0 END) ELSE 0 END)"
_DATES = rf"""WITH x AS (SELECT row_id, {_TRIMMED.format(c="created_time")} AS t FROM dataset_capability_rich), y AS (SELECT *, regexp_extract(t[12:], '([+-]\d\d(:?\d\d)?|[Zz])$', 1) AS z, regexp_extract(t, '^.{{10}}[T ](\d\d(:\d\d(:\d\d)?)?)', 1) AS h FROM x),
p AS (SELECT row_id, t, CASE WHEN {_ISO_T} THEN try_strptime(t[1:10] || ' ' || CASE length(h) WHEN 0 THEN '00:00:00' WHEN 2 THEN h || ':00:00' WHEN 5 THEN h || ':00' ELSE h END, '%Y-%m-%d %H:%M:%S') - to_minutes({_SHIFT})
 ELSE try_strptime(t, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d', '%d-%b-%Y %H:%M:%S', '%d-%b-%Y', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M']) END AS u FROM y)"""


@query(_DATES + " SELECT row_id, strftime(u, '%Y-%m-%d %H:%M:%S') AS utc FROM p")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_capability_rich").select("row_id", F.date_format(dates.parse("created_time"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(_DATES + " SELECT 'created_time' AS field, count(*) FILTER (WHERE u IS NULL AND lower(t) NOT IN ('','nan','nat','none','null','n/a','-')) AS n FROM p")
def val_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return validation.invalid_timestamps(table(spark, d, "dataset_capability_rich"), ["created_time"])


@query("SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY ALL")
def date_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = {k: dates.bucket("o_orderdate", g).alias(k) for k, g in (("y", "year"), ("q", "quarter"), ("m", "month"), ("d", "day"))}
    return table(spark, d, "orders").groupBy(*b.values()).agg(F.count("*").alias("n"))


@query("SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN acknowledged_at < alert_ts THEN 'acknowledged_at < triggered_at' END, CASE WHEN closed_at < acknowledged_at THEN 'closed_at < acknowledged_at' END, CASE WHEN acknowledged_at IS NULL AND closed_at < alert_ts THEN 'closed_at < triggered_at' END]) AS violation FROM case_context c JOIN alert_context a ON a.alert_id = c.alert_id) WHERE violation IS NOT NULL GROUP BY 1")
def chronology(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "case_context").join(table(spark, d, "alert_context").select("alert_id", "alert_ts"), "alert_id")
    return validation.chronology_counts(j, "alert_ts", "acknowledged_at", "closed_at")


# --- relationships and validation ------------------------------------------------------

_ID = lambda c: rf"CASE WHEN lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')) NOT IN ('','nan','nat','none','null','n/a','-') THEN regexp_replace({c}, '^\s+|\s+$', '', 'g') END"
REL = f"WITH a AS (SELECT DISTINCT {_ID('alert_id')} AS alert_id FROM alert_context WHERE {_ID('alert_id')} IS NOT NULL), p AS (SELECT DISTINCT {_ID('case_id')} AS case_id, {_ID('alert_id')} AS alert_id FROM case_context), l AS (SELECT * FROM p WHERE case_id IS NOT NULL AND alert_id IS NOT NULL), linked AS (SELECT DISTINCT case_id FROM l SEMI JOIN a USING (alert_id)), orphan AS (SELECT DISTINCT case_id FROM (SELECT * FROM l ANTI JOIN a USING (alert_id)) ANTI JOIN linked USING (case_id)), unmatched AS (SELECT alert_id FROM a ANTI JOIN l USING (alert_id))"


def _rel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return relations.case_links(table(spark, d, "case_context"), "case_id", "alert_id"), relations.keys(table(spark, d, "alert_context"), "alert_id", "alert_id")


@query(REL + " SELECT case_id FROM linked")
def rel_linked(spark: SparkSession, d: str) -> DataFrame:
    return relations.linked_cases(*_rel(spark, d))


@query(REL + " SELECT case_id FROM orphan")
def rel_orphan(spark: SparkSession, d: str) -> DataFrame:
    return relations.orphan_cases(*_rel(spark, d))


@query(REL + " SELECT alert_id FROM unmatched")
def rel_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return relations.unmatched_alerts(*_rel(spark, d))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS case_id FROM lineitem WHERE CAST(l_partkey AS VARCHAR) NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25)")
def rel_workflow_orphan(spark: SparkSession, d: str) -> DataFrame:
    ev = relations.keys(table(spark, d, "lineitem"), "l_partkey", "case_id")
    return relations.orphan_events(ev, relations.keys(table(spark, d, "part").where("p_size > 25"), "p_partkey", "case_id"))


REL_SUMMARY = REL + f", facts AS (SELECT 'alerts' AS fact, count(*) AS n FROM a UNION ALL SELECT 'cases', count(DISTINCT case_id) FROM p UNION ALL SELECT 'linked_cases', count(*) FROM linked UNION ALL SELECT 'orphan_cases', count(*) FROM orphan UNION ALL SELECT 'unmatched_alerts', count(*) FROM unmatched UNION ALL SELECT 'rows_without_alert_key', count(*) FROM case_context WHERE {_ID('case_id')} IS NOT NULL AND {_ID('alert_id')} IS NULL)"


@query(REL_SUMMARY + " SELECT * FROM facts")
def rel_summary(spark: SparkSession, d: str) -> DataFrame:
    return relations.summary(table(spark, d, "alert_context"), table(spark, d, "case_context"))


_UNKNOWN = f"SELECT {_TRIMMED.format(c='severity')} AS value, count(*) AS n FROM alert_context WHERE {_ID('severity')} IS NOT NULL AND (lower({_TRIMMED.format(c='severity')}) = 'unknown' OR {_word_sql(_SEVERITY_SQL, 'severity')} IS NULL) GROUP BY 1"
_FIRST_ALERT = f"(SELECT {_ID('alert_id')} AS k, min(alert_ts) AS t FROM alert_context WHERE {_ID('alert_id')} IS NOT NULL GROUP BY 1)"
_CASES = f"cx AS (SELECT c.*, a.t AS triggered_at FROM case_context c LEFT JOIN {_FIRST_ALERT} a ON {_ID('c.alert_id')} = a.k)"
_CHRONO = "SELECT unnest([CASE WHEN acknowledged_at < triggered_at THEN 'acknowledged_at < triggered_at' END, CASE WHEN closed_at < acknowledged_at THEN 'closed_at < acknowledged_at' END, CASE WHEN acknowledged_at IS NULL AND closed_at < triggered_at THEN 'closed_at < triggered_at' END]) AS v FROM cx"
_CONFLICTS = lambda t, c: f"SELECT kept || ' / ' || id AS detail FROM (SELECT DISTINCT {_ID(c)} AS id FROM {t}) i JOIN (SELECT lower(id) AS k, min(id) AS kept FROM (SELECT DISTINCT {_ID(c)} AS id FROM {t}) WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) g ON lower(id) = k WHERE id <> kept ORDER BY 1 LIMIT 5"
VAL = (
    REL_SUMMARY
    + f", {_CASES}, v AS (SELECT 'DUPLICATE_ALERT_ID' AS code, 'error' AS severity, 'alert_id' AS field, NULL AS detail, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM alert_context WHERE {_ID('alert_id')} IS NOT NULL GROUP BY {_ID('alert_id')})) AS n "
    + f"UNION ALL SELECT 'DUPLICATE_CASE_ID', 'error', 'case_id', NULL, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM case_context WHERE {_ID('case_id')} IS NOT NULL GROUP BY {_ID('case_id')})) "
    + "".join(f"UNION ALL SELECT 'CONFLICTING_IDENTIFIERS', 'error', '{c}', detail, 1 FROM ({_CONFLICTS(t, c)}) " for t, c in (("alert_context", "alert_id"), ("case_context", "case_id"), ("case_context", "alert_id")))
    + f"UNION ALL SELECT 'INVALID_SEVERITY', 'warning', 'severity', value, n FROM ({_UNKNOWN} ORDER BY 1 LIMIT 25) "
    + f"UNION ALL SELECT 'IMPOSSIBLE_CHRONOLOGY', 'error', NULL, v, count(*) FROM ({_CHRONO}) WHERE v IS NOT NULL GROUP BY v "
    + "UNION ALL SELECT 'ORPHAN_CASE', 'warning', 'alert_id', NULL, n FROM facts WHERE fact = 'orphan_cases' UNION ALL SELECT 'UNMATCHED_ALERT', 'info', 'alert_id', NULL, n FROM facts WHERE fact = 'unmatched_alerts' UNION ALL SELECT 'MISSING_JOIN_KEY', 'warning', 'alert_id', NULL, n FROM facts WHERE fact = 'rows_without_alert_key' "
    + f"UNION ALL SELECT 'ORPHAN_WORKFLOW_EVENT', 'warning', 'case_id', NULL, (SELECT count(*) FROM (SELECT DISTINCT {_ID('case_id')} AS k FROM case_context WHERE {_ID('case_id')} IS NOT NULL AND analyst_id IS NOT NULL) WHERE k NOT IN (SELECT {_ID('case_id')} FROM case_context WHERE {_ID('case_id')} IS NOT NULL AND analyst_id IS NOT NULL AND period = 'Period-1'))), "
    + "i AS (SELECT code, severity, field, detail, CAST(n AS BIGINT) AS n FROM v WHERE n > 0) "
)


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """Tables with workflow events beside: the events of all cases against the cases of one period."""
    alerts, cases = table(spark, d, "alert_context"), table(spark, d, "case_context")
    worked = cases.where("analyst_id IS NOT NULL")
    lost = validation.join_issues(None, worked.where("period = 'Period-1'"), worked, event_case="case_id").where("code = 'ORPHAN_WORKFLOW_EVENT'")
    return validation.issues(alerts, cases).unionByName(lost)


@query(VAL + "SELECT * FROM i")
def val_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


@query(VAL + "SELECT code, severity, count(*) AS issues, CAST(sum(n) AS BIGINT) AS affected, CAST(sum(CASE WHEN severity = 'error' THEN count(*) ELSE 0 END) OVER () AS BIGINT) AS errors, CAST(sum(CASE WHEN severity = 'warning' THEN count(*) ELSE 0 END) OVER () AS BIGINT) AS warnings FROM i GROUP BY code, severity")
def val_rollup(spark: SparkSession, d: str) -> DataFrame:
    return validation.rollup(_issues(spark, d))


@query(_UNKNOWN)
def val_unknown_severity(spark: SparkSession, d: str) -> DataFrame:
    return validation.unknown_values(table(spark, d, "alert_context"), "severity", "severity")


@query("SELECT 'MISSING_REQUIRED_FIELD' AS code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS field, 'CASE_ID' AS detail, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'JOIN_NOT_ASSESSABLE', 'info', NULL, 'alert/case', 1 UNION ALL SELECT 'JOIN_NOT_ASSESSABLE', 'info', NULL, 'workflow/case', 1 UNION ALL SELECT 'MAPPING_COLLISION', 'warning', 'alert_id', 'alert_context.alert_id: alert_id, alert_identifier', 1")
def val_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Checks of decisions and of joins without a key: alerts judged as if they were the case side."""
    alerts = table(spark, d, "alert_context").withColumn("alert_identifier", F.col("alert_id"))
    rows = [{"column_name": c, "category": "identifier", "samples": ["ALRT-1"]} for c in ("alert_id", "alert_identifier")]
    joins = validation.join_issues(alerts, None, alerts, event_case="event_id")
    return validation.mapping_issues(spark, "CASES", mapping.decide(rows)).unionByName(joins)


# --- capabilities ------------------------------------------------------------------------

CONCEPTS = {"SECURITY_SEVERITY": "priority", "THREAT_CATEGORY": "threat_type", "SECURITY_LABEL": "security_label", "ASSET_IDENTIFIER": "host", "EXPECTED_TELEMETRY": "telemetry_available", "EVENT_TIMESTAMP": "created_time", "RESOLUTION_TIME": "closed_time", "USER_IDENTIFIER": "closed_by", "ESCALATION_STATUS": "escalation_status", "INVESTIGATION_EVIDENCE": "investigation_notes"}
CAPABILITIES = [
    capability.Capability("THREAT_DETECTION", ("SECURITY_SEVERITY", "THREAT_CATEGORY", "SECURITY_LABEL"), ("EVENT_TIMESTAMP", "ALERT_ID"), 2, 3),
    capability.Capability("INVESTIGATION", ("INVESTIGATION_EVIDENCE",), ("USER_IDENTIFIER", "EVENT_TIMESTAMP"), 1, 2),
    capability.Capability("ESCALATION", ("ESCALATION_STATUS",), ("SECURITY_SEVERITY",), 1, 1),
    capability.Capability("RESPONSE", ("RESOLUTION_TIME",), ("EVENT_TIMESTAMP",), 1, 1),
    capability.Capability("REMEDIATION", ("REMEDIATION_ACTION",), ("USER_IDENTIFIER",), 1, 1),
]
_CAP = "SELECT cse AS entity, period, '{c}' AS concept, '{s}' AS source_column, count(*) AS populated FROM dataset_capability_rich WHERE cse IS NOT NULL AND period IS NOT NULL AND lower(regexp_replace({s}, '^\\s+|\\s+$', '', 'g')) NOT IN ('','nan','nat','none','null') GROUP BY 1, 2"
CAP = "WITH x AS (" + " UNION ALL ".join(_CAP.format(c=c, s=s) for c, s in CONCEPTS.items()) + "), h AS (SELECT entity, period, list(concept) AS have FROM x GROUP BY ALL), s AS (SELECT DISTINCT cse AS entity, period FROM dataset_capability_rich WHERE cse IS NOT NULL AND period IS NOT NULL), j AS (SELECT s.*, coalesce(have, []) AS have FROM s LEFT JOIN h USING (entity, period)), e AS (" + " UNION ALL ".join(
    f"SELECT entity, period, '{c.name}' AS capability, len(list_intersect(have, {list(c.primary)})) AS p, len(list_intersect(have, {list(c.primary + c.supporting)})) AS t, {c.min_primary} AS mp, {c.min_total} AS mt, {len(c.primary) + len(c.supporting)} AS k FROM j" for c in CAPABILITIES
) + "), r AS (SELECT entity, period, capability, CASE WHEN p = 0 THEN 'NOT_ASSESSED' WHEN p >= mp AND t >= mt THEN 'AVAILABLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CAST(p AS BIGINT) AS primary_hits, CAST(t AS BIGINT) AS total_hits, round(t / k, 4) AS coverage FROM e)"


def _capable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, d, "dataset_capability_rich").withColumn("entity", F.col("cse")).where("entity IS NOT NULL AND period IS NOT NULL")
    return capability.evidence_index(df, CONCEPTS, "row_id"), df.select("entity", "period").distinct()


@query(CAP + " SELECT * FROM x")
def evidence_index(spark: SparkSession, d: str) -> DataFrame:
    return _capable(spark, d)[0].drop("example")


@query(CAP + " SELECT * FROM r")
def capability_status(spark: SparkSession, d: str) -> DataFrame:
    return capability.evaluate(*_capable(spark, d), CAPABILITIES)


@query(CAP + " SELECT capability, count(*) FILTER (WHERE status = 'AVAILABLE') AS available, count(*) FILTER (WHERE status = 'INSUFFICIENT_EVIDENCE') AS insufficient_evidence, count(*) FILTER (WHERE status = 'NOT_ASSESSED') AS not_assessed FROM r GROUP BY 1")
def capability_summary(spark: SparkSession, d: str) -> DataFrame:
    return capability.summary(capability.evaluate(*_capable(spark, d), CAPABILITIES))


# The mapping rules as the SQL side knows them: position, concept, place, name parts, parts against it, categories, value patterns, whether it is a time.
_MAP_RULES = r"""(VALUES (1,'ALERT_ID','alert_context.alert_id',['alert_id','alert'],['time','name','level','urgency','severity','case'],['identifier'],['^[A-Z]{2,5}-\d+'],false),
(2,'SECURITY_SEVERITY','alert_context.severity',['severity','priority','urgency','risk_rating','alert_level'],[],['categorical'],['(?i)^(critical|high|medium|low)$'],false),
(3,'ASSET_IDENTIFIER','asset_context.asset_id',['host','asset','hostname','server','system'],['criticality','type','security','source'],['identifier'],['^[A-Z]{2,5}-\d+$'],false),
(4,'ASSET_CRITICALITY','asset_context.criticality',['criticality','business_impact'],[],['categorical'],['(?i)^(critical|high|medium|low)$'],false),
(5,'ESCALATION_STATUS','response_context.escalation_status',['escalation_status','escalated','referral'],[],['categorical'],['(?i)escalated'],false),
(6,'THREAT_CATEGORY','alert_context.category',['threat','attack','category'],[],['categorical'],[],false),
(7,'INVESTIGATION_EVIDENCE','investigation_context.notes',['notes','findings','remarks','investigation'],['time'],[],['\w+ \w+ \w+ \w+'],false),
(8,'EVENT_TIMESTAMP','alert_context.timestamp',['created','timestamp','triggered','raised','_ts'],['closed','_by','load'],[],['^\d{4}-\d\d-\d\d','^\d\d/\d\d/\d{4}'],true),
(9,'RESOLUTION_TIME','response_context.resolution_time',['closed_time','close_time','resolution','duration'],['_by'],[],['^\d+$'],true),
(10,'USER_IDENTIFIER','entity_context.entity_name',['_by','user','actor'],[],[],['^[a-z]+\.[a-z]$'],false),
(11,'EXPECTED_TELEMETRY','monitoring_context.expected_telemetry',['telemetry','monitoring'],[],[],['(?i)^(true|false|yes|no)$'],false),
(12,'SECURITY_LABEL','classification_context.security_label',['label','classification'],[],['categorical'],[],false),
(13,'EVENT_ID','alert_context.event_id',['event_id'],['case'],['identifier'],['^EV-\d+'],false),(14,'ALERT_NAME','alert_context.alert_name',['alert_name'],[],['categorical'],[],false),
(15,'SOURCE_SYSTEM','alert_context.source_system',['source_system'],[],['categorical'],[],false),(16,'CASE_ID','case_context.case_id',['case_id','case_number'],[],['identifier'],['^CASE-\d+'],false),
(17,'CASE_ALERT_ID','case_context.alert_id',['case_alert'],[],['identifier'],[],false),(18,'ACKNOWLEDGED_AT','case_context.acknowledged_at',['acknowledged','ack_time'],[],[],['^\d{4}-\d\d-\d\d'],true),
(19,'CLOSED_AT','case_context.closed_at',['closed_at'],['_by'],[],['^\d{4}-\d\d-\d\d'],true),(20,'ANALYST_ID','case_context.analyst_id',['analyst_id'],[],['identifier'],['^ANL-\d+'],false),
(21,'ESCALATION_LEVEL','case_context.escalation_level',['escalation_level','tier'],[],['categorical'],['^L\d$'],false),(22,'CLOSURE_DISPOSITION','case_context.closure_disposition',['disposition'],[],['categorical'],[],false),
(23,'WORKFLOW_CASE_ID','workflow_context.case_id',['event_case'],[],['identifier'],[],false),(24,'WORKFLOW_EVENT_AT','workflow_context.event_at',['event_at'],[],[],['^\d{4}-\d\d-\d\d'],true),
(25,'WORKFLOW_EVENT_TYPE','workflow_context.event_type',['event_type'],[],['categorical'],[],false),(26,'ASSET_TYPE','asset_context.asset_type',['asset_type'],[],['categorical'],[],false),
(27,'NETWORK_ZONE','asset_context.network_zone',['network_zone','zone'],[],['categorical'],[],false)) AS t(pos, concept, path, yes, no, cats, vals, is_time)"""
_MAP_COLUMNS = [("row_id", True), ("feed_id", True), ("load_no", True), ("root_cause_identified", True), *[(c, False) for c in ("cse", "period", "alert_id", "priority", "threat_type", "security_label", "host", "asset_criticality", "telemetry_available", "created_time", "closed_time", "closed_by", "escalation_status", "investigation_notes")]]
_MAP_SQL = (
    "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {str(n).lower()} AS num, row_id AS r, CAST({c} AS VARCHAR) AS v FROM dataset_capability_rich" for c, n in _MAP_COLUMNS) + f"), d AS (SELECT c, num, v, min(r) AS f FROM cells WHERE v IS NOT NULL AND v NOT IN ({_NA}) GROUP BY ALL), "
    "s AS (SELECT c, first(num) AS num, count(*) AS uniques, list(v ORDER BY f, v)[1:10] AS samples FROM d GROUP BY c), "
    "k AS (SELECT c, samples, CASE WHEN num THEN 'numeric' WHEN len(list_filter(['id','host','hostname','asset','device','server','system','machine'], lambda h: contains(c, h))) > 0 THEN 'identifier' WHEN uniques / (SELECT count(*) FROM dataset_capability_rich) > 0.8 AND list_avg(list_transform(samples, lambda x: length(x))) >= 6 AND len(list_filter(samples, lambda x: lower(x) IN ('critical','high','medium','low','open','closed','pending','yes','no','true','false'))) = 0 THEN 'identifier' ELSE 'categorical' END AS cat FROM s), "
    f"p AS (SELECT k.c, t.*, round(greatest(0, least(1, CASE WHEN len(list_filter(yes, lambda w: contains(c, w))) > 0 THEN least(0.5 + 0.1 * (len(list_filter(yes, lambda w: contains(c, w))) - 1), 0.7) ELSE 0 END - least(0.25 * len(list_filter(no, lambda w: contains(c, w))), 0.5) + CASE WHEN list_contains(cats, cat) THEN 0.25 ELSE 0 END + 0.25 * len(list_filter(vals, lambda w: len(list_filter(samples, lambda x: regexp_matches(x, w))) > 0)))), 2) AS score FROM k, {_MAP_RULES}), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, pos) AS rn FROM p WHERE score >= 0.45), b AS (SELECT * FROM q WHERE rn = 1), "
    "v AS (SELECT b.*, (SELECT max(score) FROM q WHERE q.c = b.c AND q.path <> b.path) AS rival FROM b), "
    "st AS (SELECT *, CASE WHEN is_time AND c LIKE '%\\_by' ESCAPE '\\' THEN 'names an actor, not a time' WHEN concept = 'RESOLUTION_TIME' AND (contains(c, 'closed_by') OR contains(c, 'created') OR contains(c, 'opened')) THEN 'is not a resolution time' END AS bad, CASE WHEN rival IS NOT NULL AND score - rival < 0.10 - 1e-9 THEN 'AMBIGUOUS' WHEN score >= 0.6 THEN 'MAPPED' ELSE 'LOW_CONFIDENCE' END AS s0 FROM v), "
    "w AS (SELECT *, CASE WHEN bad IS NULL AND s0 <> 'AMBIGUOUS' THEN row_number() OVER (PARTITION BY path, bad IS NULL AND s0 <> 'AMBIGUOUS' ORDER BY score DESC, c) END AS place FROM st), "
    "z AS (SELECT c, concept, path, score, CASE WHEN bad IS NOT NULL THEN 'INVALID' WHEN place > 1 THEN 'AMBIGUOUS' ELSE s0 END AS state, CASE WHEN bad IS NOT NULL THEN bad WHEN place > 1 THEN 'another column holds this place' WHEN s0 = 'AMBIGUOUS' THEN 'another concept is as likely' WHEN s0 = 'MAPPED' THEN 'clear' ELSE 'likely' END AS reason FROM w) "
    "SELECT n.c AS column_name, concept, path, CAST(coalesce(score, 0) AS DOUBLE) AS confidence, coalesce(state, 'UNMAPPED') AS state, coalesce(reason, 'no concept reaches the least confidence') AS reason, coalesce(state IN ('MAPPED', 'LOW_CONFIDENCE'), false) AS applied FROM (VALUES "
    + ", ".join(f"('{c}')" for c, _ in _MAP_COLUMNS)
    + ") AS n(c) LEFT JOIN z USING (c)"
)


@query(_MAP_SQL)
def mapping_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.profile_rows(table(spark, d, "dataset_capability_rich").drop("received_at"), "row_id")
    ds = mapping.decide(rows)
    return spark.createDataFrame([(x.column, x.concept, x.path, x.confidence, x.state, x.reason, x.applied) for x in ds], "column_name string, concept string, path string, confidence double, state string, reason string, applied boolean")


# --- concentration and repetition ----------------------------------------------------


@query(
    REC
    + ", n AS (SELECT entity, period, count(*) AS n_records FROM rec GROUP BY ALL), g AS (SELECT entity, period, segment, count(*) AS c, min(row_ordinal) AS f FROM rec GROUP BY ALL), b AS (SELECT entity, period, arg_max(segment, c * 1000000000000 - f) AS busiest, max(c) AS k_busiest, count(*) AS n_groups FROM g GROUP BY ALL), s AS (SELECT * FROM n JOIN b USING (entity, period)), t AS (SELECT entity, period, n_records, k_busiest, n_groups, unnest(range(k_busiest, n_records + 1)) AS x FROM s WHERE n_groups >= 2), u AS (SELECT entity, period, lgamma(n_records + 1) - lgamma(x + 1) - lgamma(n_records - x + 1) + x * ln(1.0 / n_groups) + (n_records - x) * ln(1 - 1.0 / n_groups) AS l FROM t), m AS (SELECT entity, period, max(l) AS m FROM u GROUP BY ALL), w AS (SELECT entity, period, least(0, (m + ln(sum(exp(l - m)))) / ln(10)) AS lt FROM u JOIN m USING (entity, period) GROUP BY entity, period, m) "
    "SELECT entity, period, n_records, n_groups, upper(busiest) AS busiest, k_busiest, round(lt, 6) AS log10_tail, CASE WHEN n_groups < 2 THEN 'EVIDENCE_NOT_PRESENT' WHEN n_records < 12 OR n_groups < 3 OR k_busiest < 4 THEN 'NOT_EVALUABLE' WHEN pow(10, lt) <= 0.01 THEN 'CONCENTRATION' ELSE 'NO_CONCENTRATION' END AS status FROM s LEFT JOIN w USING (entity, period)"
)
def concentration_binomial(spark: SparkSession, d: str) -> DataFrame:
    return patterns.concentration(records(spark, d), "segment", "row_ordinal")


SETS = r"WITH t AS (SELECT cse, period, row_id AS id, list_sort(list_distinct(regexp_extract_all(lower(analyst_findings), '[a-z0-9]+'))) AS toks FROM dataset_operational_pattern_renamed WHERE analyst_findings IS NOT NULL AND cse IS NOT NULL AND period IS NOT NULL), s AS (SELECT cse, period, toks, min(id) AS id, count(*) AS copies FROM t WHERE len(toks) > 0 GROUP BY ALL), p AS (SELECT cse, period, x.id AS a, y.id AS b, len(list_intersect(x.toks, y.toks)) AS c, len(x.toks) AS na, len(y.toks) AS nb FROM s x JOIN s y USING (cse, period) WHERE x.id <> y.id), q AS (SELECT cse, period, a, b, c / (na + nb - c) AS j FROM p)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return similarity.token_sets(table(spark, d, "dataset_operational_pattern_renamed").where("cse IS NOT NULL AND period IS NOT NULL"), ["cse", "period"], "row_id", "analyst_findings")


@query(SETS + " SELECT cse, period, a, b, round(j, 6) AS similarity FROM q WHERE j >= 0.8 AND a < b")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(_sets(spark, d), ["cse", "period"], 0.8)


@query(SETS + ", m AS (SELECT cse, period, a AS id, max(j) AS j FROM q GROUP BY ALL) SELECT s.cse, s.period, s.id, s.copies, round(CASE WHEN s.copies > 1 THEN 1.0 ELSE coalesce(m.j, 0.0) END, 6) AS max_similarity FROM s LEFT JOIN m ON s.cse = m.cse AND s.period = m.period AND s.id = m.id")
def max_similarity(spark: SparkSession, d: str) -> DataFrame:
    return similarity.max_similarity(_sets(spark, d), ["cse", "period"])


@query(
    SETS.replace("WITH t", "WITH RECURSIVE t")
    + ", e AS (SELECT cse, period, a, b FROM q WHERE j >= 0.8), r AS (SELECT cse, period, id, id AS root FROM s UNION SELECT r.cse, r.period, e.b, r.root FROM r JOIN e ON e.cse = r.cse AND e.period = r.period AND e.a = r.id), c AS (SELECT cse, period, id, min(root) AS component FROM r GROUP BY ALL), z AS (SELECT cse, period, component, sum(copies) AS n_similar FROM s JOIN c USING (cse, period, id) GROUP BY ALL), y AS (SELECT cse, period, sum(n_similar) AS records, arg_max(n_similar, n_similar * 1000000000 - component) AS n_similar, arg_max(component, n_similar * 1000000000 - component) AS component FROM z GROUP BY ALL) "
    ", mb AS (SELECT s.cse, s.period, s.id, s.toks, s.copies, y.component FROM y JOIN c ON c.cse = y.cse AND c.period = y.period AND c.component = y.component JOIN s ON s.cse = c.cse AND s.period = c.period AND s.id = c.id), pr AS (SELECT cse, period, 1.0::DOUBLE AS j, copies * (copies - 1) / 2 AS w FROM mb WHERE copies > 1 UNION ALL SELECT q.cse, q.period, q.j, x.copies * z.copies FROM q JOIN mb x ON x.cse = q.cse AND x.period = q.period AND x.id = q.a JOIN mb z ON z.cse = q.cse AND z.period = q.period AND z.id = q.b WHERE q.a < q.b AND q.j >= 0.8), st AS (SELECT cse, period, round(min(j), 4) AS lo, round(sum(j * w) / sum(w), 4) AS mean, round(max(j), 4) AS hi FROM pr GROUP BY ALL), "
    r"asst AS (SELECT mb.cse, mb.period, count(DISTINCT r.asset_name) AS assets FROM mb JOIN dataset_operational_pattern_renamed r ON r.cse = mb.cse AND r.period = mb.period AND list_sort(list_distinct(regexp_extract_all(lower(r.analyst_findings), '[a-z0-9]+'))) = mb.toks GROUP BY ALL) "
    "SELECT y.cse, y.period, CAST(records AS BIGINT) AS records, CAST(n_similar AS BIGINT) AS n_similar, component, lo AS min_similarity, mean AS mean_similarity, hi AS max_similarity, assets, CASE WHEN records < 12 OR n_similar < 3 THEN 'NOT_EVALUABLE' ELSE 'REPETITION' END AS status FROM y LEFT JOIN st USING (cse, period) LEFT JOIN asst USING (cse, period)"
)
def repetition_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_operational_pattern_renamed").where("cse IS NOT NULL AND period IS NOT NULL")
    return similarity.repetition(_sets(spark, d), ["cse", "period"], 0.8, 12, 3, t.select("cse", "period", "asset_name", tokens("analyst_findings").alias("toks")), "asset_name")


@query(SETS + " SELECT cse, period, a, b, round(j, 6) AS similarity FROM q WHERE j >= 0.9 AND a < b")
def minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from the band index; at 0.9 the chance to miss one is below 1e-28."""
    sets = _sets(spark, d)
    return similarity.indexed_pairs(sets, similarity.band_index(sets, ["cse", "period"]), ["cse", "period"], 0.9)


@query(SETS.replace("WHERE analyst_findings IS NOT NULL", f"WHERE upper({_TRIMMED.format(c='analyst_findings')}) NOT IN ('','NAN','N/A','NA','NONE','NULL','NIL','-','--','UNKNOWN')") + ", m AS (SELECT cse, period, a AS id, max(j) AS j FROM q GROUP BY ALL), x AS (SELECT s.cse, s.period, s.copies, CASE WHEN s.copies > 1 THEN 1.0::DOUBLE ELSE coalesce(m.j, 0.0) END AS v FROM s LEFT JOIN m ON s.cse = m.cse AND s.period = m.period AND s.id = m.id) SELECT cse AS entity, period, CASE WHEN sum(copies) < 2 THEN 0.0 ELSE round(sum(copies * v) / sum(copies), 6) END AS mean_max_token_similarity FROM x GROUP BY ALL")
def fx_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_operational_pattern_renamed").where("cse IS NOT NULL AND period IS NOT NULL").withColumnsRenamed({"cse": "entity", "row_id": "row_ordinal"})
    return features.mean_max_token_similarity(t, "analyst_findings")


# --- peers -----------------------------------------------------------------------------


def _rates(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("entity", "period", "sector").agg(F.count("*").alias("records"), F.count_if(rules.gap_state(GAP) == rules.VIOLATED).alias("violated"))
    return g.select("entity", "period", "sector", F.round(F.col("violated") / F.col("records"), 6).alias("rate"))


PEERS = RATE_SQL + ", f AS (SELECT t.entity, t.period, t.rate, p.rate AS x FROM m t JOIN m p ON t.period = p.period AND t.entity <> p.entity), g2 AS (SELECT entity, period, rate, count(*) AS peers, min(x) AS lo, round(quantile_cont(x, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(x, 0.5) + 1e-9, 6) AS median, round(quantile_cont(x, 0.75) + 1e-9, 6) AS q3, max(x) AS hi, count(*) FILTER (WHERE x < rate) AS below, count(*) FILTER (WHERE x = rate) AS equal FROM f GROUP BY ALL), d AS (SELECT entity, period, round(quantile_cont(abs(x - median), 0.5) + 1e-9, 6) AS mad FROM f JOIN g2 USING (entity, period, rate) GROUP BY ALL), s AS (SELECT *, CASE WHEN mad > 0 THEN round(0.6745 * (rate - median) / mad + 1e-9, 6) END AS z FROM g2 JOIN d USING (entity, period))"


@query(PEERS + " SELECT entity, period, rate, peers, CASE WHEN peers < 3 THEN 'UNAVAILABLE' WHEN peers < 8 THEN 'LIMITED' ELSE 'ROBUST' END AS baseline, lo, q1, median, q3, hi, mad, z AS modified_z, below + 1 AS rank, round((below + 0.5 * equal) / peers + 1e-9, 6) AS percentile, CASE WHEN peers >= 4 THEN round(q1 - 1.5 * (q3 - q1) + 1e-9, 6) END AS lower_fence, CASE WHEN peers >= 4 THEN round(q3 + 1.5 * (q3 - q1) + 1e-9, 6) END AS upper_fence, CASE WHEN abs(z) > 3.5 THEN 'STRONG' WHEN abs(z) > 1.5 THEN 'MODERATE' WHEN z IS NOT NULL THEN 'TYPICAL' END AS band FROM s")
def peer_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return robust.summaries(_rates(spark, d))


@query(RATE_SQL + ", a AS (SELECT m.entity, m.period, count(*) FILTER (WHERE p.sector = m.sector) AS n1, count(*) AS n2 FROM m JOIN m p ON m.period = p.period AND m.entity <> p.entity GROUP BY ALL) SELECT entity, period, CAST(CASE WHEN n1 > 0 THEN 1 ELSE 2 END AS BIGINT) AS tier, CASE WHEN n1 > 0 THEN n1 ELSE n2 END AS peers FROM a")
def cohort_tier(spark: SparkSession, d: str) -> DataFrame:
    return robust.cohort_tiers(_rates(spark, d), [["period", "sector"], ["period"]])


@query(RATE_SQL + " SELECT sector, count(*) AS n, min(rate) AS lo, round(quantile_cont(rate, 0.1) + 1e-9, 6) AS p10, round(quantile_cont(rate, 0.5) + 1e-9, 6) AS median, round(quantile_cont(rate, 0.9) + 1e-9, 6) AS p90, max(rate) AS hi, round(avg(rate) + 1e-9, 6) AS mean, round(stddev_pop(rate) + 1e-9, 6) AS std FROM m GROUP BY sector")
def rate_distribution(spark: SparkSession, d: str) -> DataFrame:
    return robust.distribution(_rates(spark, d), "rate", ["sector"])


# --- features and anomalies --------------------------------------------------------------

FEATURES = ["scope_record_count", "critical_share", "mean_severity", "escalation_populated", "escalated_share", "concept_coverage", "severity_entropy", "max_group_share"]


@query(
    REC
    + ", b AS (SELECT entity, period, count(*) AS scope_record_count, CASE WHEN count(severity) > 0 THEN round(count(*) FILTER (WHERE severity = 'CRITICAL') / count(severity), 6) END AS critical_share, round(avg(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END) / 4, 6) AS mean_severity, CASE WHEN count(escalation) > 0 THEN round(count(escalation) / count(*), 6) END AS escalation_populated, CASE WHEN count(*) FILTER (WHERE escalation IN ('ESCALATED','NOT_ESCALATED')) > 0 THEN round(count(*) FILTER (WHERE escalation = 'ESCALATED') / count(*) FILTER (WHERE escalation IN ('ESCALATED','NOT_ESCALATED')), 6) END AS escalated_share, CASE WHEN count(severity) > 0 AND count(escalation) > 0 THEN round((count(severity) + count(escalation) + count(asset)) / (count(*) * 3), 6) END AS concept_coverage FROM rec GROUP BY entity, period), e1 AS (SELECT entity, period, severity, count(*) AS n FROM rec WHERE severity IS NOT NULL GROUP BY ALL), e AS (SELECT entity, period, abs(round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(4), 6)) AS severity_entropy FROM e1 GROUP BY ALL), g1 AS (SELECT entity, period, asset, count(*) AS n FROM rec GROUP BY ALL), g AS (SELECT entity, period, round(max(n) / sum(n), 6) AS max_group_share FROM g1 GROUP BY ALL) SELECT * FROM b LEFT JOIN e USING (entity, period) LEFT JOIN g USING (entity, period)"
)
def fx_features(spark: SparkSession, d: str) -> DataFrame:
    return features.scope_features(records(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    f = features.scope_features(records(spark, d)).checkpoint()  # one row per scope, read by training, the cut and the result
    return forest.score(f, forest.train(f, FEATURES, ["entity", "period"]), FEATURES).checkpoint()


@query()
def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("entity", "period", "score", "verdict")


@query()
def forest_contributors(spark: SparkSession, d: str) -> DataFrame:
    e = forest.explain(_scored(spark, d), FEATURES, ["entity", "period"])
    return e.select("entity", "period", "verdict", F.posexplode("contributors").alias("position", "c")).select("entity", "period", "verdict", "position", "c.feature", F.round("c.distance", 6).alias("distance"))


# --- scoring, agreement, integrity -----------------------------------------------------


@query(REC + f", f AS (SELECT entity, count(*) AS gap_n FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED' GROUP BY 1), a AS (SELECT entity, count(*) AS absent_n FROM rec WHERE severity = 'CRITICAL' AND escalation = 'PENDING' GROUP BY 1) SELECT entity, coalesce(gap_n, 0) AS gap_n, coalesce(absent_n, 0) AS absent_n FROM f FULL JOIN a USING (entity)")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    n = lambda df: df.groupBy("entity").agg(F.count("*").alias("n"))
    return scoring.combine({"gap": n(r.where(rules.gap_state(GAP) == rules.VIOLATED)), "absent": n(r.where("severity = 'CRITICAL' AND escalation = 'PENDING'"))}, "entity")


@query(REC + ", e AS (SELECT entity, count(*) AS records, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM rec GROUP BY 1) SELECT *, round(avg(records) OVER (), 6) AS mean_records, round(records - avg(records) OVER (), 6) AS dev_records, round(avg(critical) OVER (), 6) AS mean_critical, round(critical - avg(critical) OVER (), 6) AS dev_critical FROM e")
def peer_mean_dev(spark: SparkSession, d: str) -> DataFrame:
    e = records(spark, d).groupBy("entity").agg(F.count("*").alias("records"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    return scoring.against_mean(e, ["records", "critical"])


@query("SELECT p_partkey, unnest(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: NOT list_contains(string_split(lower(p_type) || ' ring', ' '), x))) AS missing FROM part")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("have", F.concat(F.lower("p_type"), F.lit(" ring")))
    return scoring.set_difference(p, "p_partkey", "p_name", "have", " ")


@query("SELECT c_custkey AS asset, count(o_orderkey) AS alerts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def asset_alert_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("asset")).agg(F.count("*").alias("alerts"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("asset")).join(n, "asset", "left").select("asset", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query(REC + f" SELECT entity, count(*) FILTER (WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED') AS violated, count(*) FILTER (WHERE {STATE_SQL} = 'EXPECTATION_SATISFIED') AS satisfied, count(DISTINCT asset) AS assets FROM rec GROUP BY 1")
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    s = rules.gap_state(GAP)
    return records(spark, d).groupBy("entity").agg(F.count_if(s == rules.VIOLATED).alias("violated"), F.count_if(s == rules.SATISFIED).alias("satisfied"), F.countDistinct("asset").alias("assets"))


@query(REC + f", f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY amount DESC, row_ordinal) AS position FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED') SELECT entity, row_ordinal, amount, position FROM f WHERE position <= 8")
def review_top8(spark: SparkSession, d: str) -> DataFrame:
    f = records(spark, d).where(rules.gap_state(GAP) == rules.VIOLATED).select("entity", "row_ordinal", "amount")
    return scoring.top_per_group(f, ["entity"], [F.desc("amount"), F.col("row_ordinal")], 8)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'returned_at_discount' WHEN l_quantity > 45 THEN 'large' WHEN l_tax = 0 THEN 'untaxed' ELSE 'none' END AS finding FROM lineitem")
def findings_cascade(spark: SparkSession, d: str) -> DataFrame:
    c = scoring.first_match([((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), "returned_at_discount"), (F.col("l_quantity") > 45, "large"), (F.col("l_tax") == 0, "untaxed")], "none")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("finding"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, d)
    e = rules.gap_counts(r, GAP).where("violated > 0").select("entity", "period", F.lit("execution_gap").alias("family"))
    h = r.where("severity = 'CRITICAL' AND escalation = 'NOT_ESCALATED' AND amount > 250000").select("entity", "period", F.lit("execution_gap").alias("family")).distinct()
    return e, h


AGREE = REC + f", e AS (SELECT DISTINCT entity, period FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED'), h AS (SELECT DISTINCT entity, period FROM rec WHERE severity = 'CRITICAL' AND escalation = 'NOT_ESCALATED' AND amount > 250000)"


@query(AGREE + " SELECT 'execution_gap' AS family, (SELECT count(*) FROM e SEMI JOIN h USING (entity, period)) AS matches, (SELECT count(*) FROM e) AS engine, (SELECT count(*) FROM h) AS reviewer, round((SELECT count(*) FROM e SEMI JOIN h USING (entity, period)) / (SELECT count(*) FROM e), 4) AS precision, round((SELECT count(*) FROM e SEMI JOIN h USING (entity, period)) / (SELECT count(*) FROM h), 4) AS recall")
def agreement_metrics(spark: SparkSession, d: str) -> DataFrame:
    return agreement.metrics(*_sides(spark, d))


@query(AGREE + " SELECT coalesce(e.entity, h.entity) AS entity, coalesce(e.period, h.period) AS period, 'execution_gap' AS family, CASE WHEN e.entity IS NOT NULL AND h.entity IS NOT NULL THEN 'MATCH' WHEN e.entity IS NOT NULL AND e.entity IN (SELECT entity FROM h) THEN 'SCOPE_MISMATCH' WHEN h.entity IS NOT NULL AND h.entity IN (SELECT entity FROM e) THEN 'SCOPE_MISMATCH' WHEN e.entity IS NOT NULL THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS agreement FROM e FULL JOIN h ON e.entity = h.entity AND e.period = h.period")
def agreement_compare(spark: SparkSession, d: str) -> DataFrame:
    return agreement.compare(*_sides(spark, d))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return integrity.text_digests(table(spark, d, "documents"), "doc_id", "text")


# --- stream ------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    w = counts.windowed(table(spark, d, "events"), "ts", ["event_type"])
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query(ORACLE["window_counts"])
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts through a stream that reads the file once and stops."""
    import uuid

    ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{run}"
    out = counts.run_to_files(counts.windowed(src, "ts", ["event_type"]), f"{place}/out", f"{place}/state")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")
