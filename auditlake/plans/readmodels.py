"""Registered queries of read models, metrics, joins, texts, agreement checks and the whole assessment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import texts
from auditlake.operators import agreement, capability, concepts, features, filters, flags, forest, integrity, mapping, metrics, patterns, profile, relations, robust, rules, scopes, scoring, views
from auditlake.plans import layers
from auditlake.plans.layers import ABS_SQL, CAP, GAP, RATE_SQL, REC, STATE_SQL
from auditlake.plans.pipeline import Assessment
from auditlake.plans.records import records
from auditlake.session import ensure_checkpoint_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- findings and their views ------------------------------------------------------------


def _findings(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return views.unified_findings({"execution_gap": rules.gap_findings(r, GAP), "negative_space": rules.absence_findings(rules.absence_measures(r, layers.ABSENCE), layers.ABSENCE)})


FIND = ABS_SQL + f", fx AS (SELECT 'execution_gap' AS family, entity, period, 'critical_needs_escalation' AS indicator, CAST(NULL AS VARCHAR) AS status, CAST(row_ordinal AS BIGINT) AS row_ordinal, 'severity=' || severity || '; escalation=' || escalation AS evidence FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED' UNION ALL SELECT 'negative_space', entity, period, 'critical_expects_decision', CASE state WHEN 'COMPLETE_ABSENCE' THEN 'POTENTIAL_NEGATIVE_SPACE' ELSE 'PARTIAL_NEGATIVE_SPACE' END, NULL, NULL FROM a WHERE state IN ('COMPLETE_ABSENCE','PARTIAL_ABSENCE'))"


@query(FIND + " SELECT * FROM fx")
def findings_all(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@query(FIND + " SELECT family, count(*) AS n FROM fx GROUP BY 1")
def findings_by_family(spark: SparkSession, d: str) -> DataFrame:
    return views.family_totals(_findings(spark, d))


ROWS = FIND + ", sc AS (SELECT entity, period, count(*) AS records FROM rec GROUP BY ALL), fc AS (SELECT entity, period, count(*) FILTER (WHERE family = 'execution_gap') AS execution_gap, count(*) FILTER (WHERE family = 'negative_space') AS negative_space FROM fx GROUP BY ALL), er AS (SELECT entity, period, records, coalesce(execution_gap, 0) AS execution_gap, coalesce(negative_space, 0) AS negative_space FROM sc LEFT JOIN fc USING (entity, period)), ew AS (SELECT *, execution_gap + negative_space AS signals, CASE WHEN execution_gap > negative_space THEN 'execution_gap' WHEN negative_space > execution_gap THEN 'negative_space' END AS leading_family FROM er)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return views.entity_rows(_findings(spark, d), scopes.scope_counts(records(spark, d)), ["execution_gap", "negative_space"])


@query(ROWS + " SELECT * FROM ew")
def scope_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d)


@query(ROWS + " SELECT * FROM ew ORDER BY signals DESC, records DESC, entity, period LIMIT 20")
def scope_rows_first(spark: SparkSession, d: str) -> DataFrame:
    """The first page of scopes by signals (a top-k report)."""
    return views.ranked_entities(_rows(spark, d)).limit(20)


@query(FIND + " SELECT * FROM fx WHERE family = 'execution_gap' AND contains(lower(indicator || ' ' || coalesce(evidence, '') || ' ' || entity), 'nation_1')")
def findings_filtered(spark: SparkSession, d: str) -> DataFrame:
    return views.filter_findings(_findings(spark, d), "execution_gap", None, "Nation_1")


@query(FIND + ", mt AS (SELECT *, CASE WHEN row_ordinal IS NOT NULL THEN count(*) OVER (PARTITION BY entity, period, row_ordinal) ELSE 0 END AS meeting FROM fx) SELECT * FROM mt ORDER BY row_ordinal IS NULL, CASE family WHEN 'execution_gap' THEN 0 WHEN 'negative_space' THEN 1 ELSE 2 END, meeting DESC, indicator, entity, period, row_ordinal LIMIT 8")
def review_samples(spark: SparkSession, d: str) -> DataFrame:
    return views.review_samples(_findings(spark, d), ["execution_gap", "negative_space"])


@query(REC + " SELECT DISTINCT entity FROM rec")
def entity_options(spark: SparkSession, d: str) -> DataFrame:
    return views.options(scopes.scope_counts(records(spark, d)), "entity")


@query(CAP + " SELECT entity, period, status, count(*) AS n FROM r GROUP BY ALL")
def capability_tally(spark: SparkSession, d: str) -> DataFrame:
    return views.capability_tally(capability.evaluate(*layers._capable(spark, d), layers.CAPABILITIES))


def _registry_sql() -> str:
    """The eight capabilities over the whole dataset, by their primary and other concepts as the table holds them."""
    rows = [
        ("THREAT_DETECTION", ["SECURITY_SEVERITY", "THREAT_CATEGORY", "SECURITY_LABEL"], ["EVENT_TIMESTAMP"], 2, 3, 5), ("INVESTIGATION", ["INVESTIGATION_EVIDENCE"], ["USER_IDENTIFIER", "EVENT_TIMESTAMP"], 1, 2, 6), ("ESCALATION", ["ESCALATION_STATUS"], ["SECURITY_SEVERITY"], 1, 1, 3),
        ("INCIDENT_RESPONSE", ["RESOLUTION_TIME"], ["EVENT_TIMESTAMP"], 1, 1, 5), ("SECURITY_OPERATIONS", ["ASSET_IDENTIFIER"], ["EVENT_TIMESTAMP"], 1, 3, 5), ("GOVERNANCE_OVERSIGHT", ["USER_IDENTIFIER"], [], 1, 1, 2),
        ("OPERATIONAL_DISCIPLINE", ["RESOLUTION_TIME", "SECURITY_SEVERITY"], ["INVESTIGATION_EVIDENCE", "EVENT_TIMESTAMP", "ESCALATION_STATUS"], 1, 3, 5), ("CYBER_RESILIENCE", ["RESOLUTION_TIME"], ["EVENT_TIMESTAMP"], 1, 3, 4),
    ]
    one = "SELECT '{n}' AS capability, CAST(len(list_intersect(have, {p})) AS BIGINT) AS primary_hits, CAST(len(list_intersect(have, {t})) AS BIGINT) AS total_hits, {mp} AS mp, {mt} AS mt, {k} AS k FROM w"
    parts = " UNION ALL ".join(one.format(n=n, p=p, t=p + s, mp=mp, mt=mt, k=k) for n, p, s, mp, mt, k in rows)
    return CAP.split(", h AS (")[0] + f", w AS (SELECT list(DISTINCT concept) AS have FROM x), e AS ({parts}) SELECT capability, CASE WHEN primary_hits = 0 THEN 'NOT_ASSESSED' WHEN primary_hits >= mp AND total_hits >= mt THEN 'AVAILABLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, primary_hits, total_hits, round(total_hits / k, 4) AS coverage FROM e"


@query(_registry_sql())
def capability_dataset(spark: SparkSession, d: str) -> DataFrame:
    return capability.evaluate_dataset(layers._capable(spark, d)[0], capability.REGISTRY)


# --- metrics -------------------------------------------------------------------------------

_LONG = "CAST({n} AS BIGINT) AS numerator, CAST({t} AS BIGINT) AS denominator, CASE WHEN {t} > 0 THEN round({n} / {t}, 6) END AS rate, CASE WHEN {t} > 0 THEN 'COMPUTED' ELSE 'NOT_EVALUABLE' END AS metric_status, CASE WHEN NOT coalesce({t} > 0, false) THEN '{w}' END AS reason"


@query(REC + f", g AS (SELECT entity, period, count(*) AS t, count(*) FILTER (WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED') AS n FROM rec GROUP BY ALL) SELECT entity, period, 'execution_gap_incidence' AS metric, " + _LONG.format(n="n", t="t", w="the scope holds no records") + " FROM g")
def metric_gaps(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return metrics.flagged_incidence(scopes.scope_counts(r), rules.gap_findings(r, GAP), "execution_gap_incidence")


@query(ABS_SQL + ", g AS (SELECT entity, period, triggered AS t, CASE WHEN triggered > 0 THEN without_evidence END AS n FROM a) SELECT entity, period, 'negative_space_incidence' AS metric, " + _LONG.format(n="n", t="t", w="no expectation was triggered in the scope") + " FROM g")
def metric_absences(spark: SparkSession, d: str) -> DataFrame:
    return metrics.absence_incidence(rules.absence_measures(records(spark, d), layers.ABSENCE))


@query(CAP + ", g AS (SELECT entity, period, count(*) AS t, count(*) FILTER (WHERE status = 'AVAILABLE') AS n FROM r WHERE capability IN ('ESCALATION', 'RESPONSE') GROUP BY ALL) SELECT entity, period, 'response_coverage' AS metric, " + _LONG.format(n="n", t="t", w="no capability of this kind is declared") + " FROM g")
def metric_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return metrics.capability_coverage(capability.evaluate(*layers._capable(spark, d), layers.CAPABILITIES), "response_coverage", ["ESCALATION", "RESPONSE"])


@query("SELECT CAST(0 AS BIGINT) AS wrong_sums, CAST(1 AS BIGINT) AS consistent_rate")
def metric_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Anomaly rate against the verdict counts of the same forest: parts add up, the rate is theirs."""
    s = layers._scored(spark, d)
    v = {r.verdict: r.n for r in views.verdict_view(s).collect()}
    a = metrics.anomaly_rate(s)
    odd = v.get("POTENTIAL_OPERATIONAL_ANOMALY", 0)
    known = odd + v.get("WITHIN_REFERENCE", 0)
    wrong = F.when((F.col("anomalous") == odd) & (F.col("evaluated") == known) & (F.col("not_evaluable") == v.get("NOT_EVALUABLE", 0)), 0).otherwise(1)
    return a.select(wrong.cast("bigint").alias("wrong_sums"), (F.abs(F.col("rate") - odd / max(1, known)) < 1e-6).cast("bigint").alias("consistent_rate"))


# --- peers -----------------------------------------------------------------------------------

PEER_TIERS = (
    RATE_SQL
    + ", ch AS (SELECT m.entity, m.period, CAST(CASE WHEN count(*) FILTER (WHERE p.sector = m.sector) > 0 THEN 1 ELSE 2 END AS BIGINT) AS tier FROM m JOIN m p ON m.period = p.period AND m.entity <> p.entity GROUP BY ALL), fp AS (SELECT t.entity, t.period, t.rate, tier, p.rate AS x FROM m t JOIN ch USING (entity, period) JOIN m p ON t.period = p.period AND t.entity <> p.entity AND (tier = 2 OR t.sector = p.sector)), gx AS (SELECT entity, period, rate, tier, count(*) AS peers, min(x) AS lo, round(quantile_cont(x, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(x, 0.5) + 1e-9, 6) AS median, round(quantile_cont(x, 0.75) + 1e-9, 6) AS q3, max(x) AS hi, count(*) FILTER (WHERE x < rate) AS below FROM fp GROUP BY ALL)"
    + " SELECT entity, period, tier, rate, peers, CASE WHEN peers < 3 THEN 'UNAVAILABLE' WHEN peers < 8 THEN 'LIMITED' ELSE 'ROBUST' END AS baseline, lo, q1, median, q3, hi, below + 1 AS rank FROM gx"
)


@query(PEER_TIERS)
def peer_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Targets against their own sector, or their period where the sector has no other entity."""
    return robust.tier_summaries(layers._rates(spark, d), [["period", "sector"], ["period"]]).select("entity", "period", "tier", "rate", "peers", "baseline", "lo", "q1", "median", "q3", "hi", "rank")


@query(layers.PEERS + " SELECT entity, period, modified_z FROM (SELECT entity, period, peers, z AS modified_z FROM s) WHERE modified_z IS NOT NULL AND peers >= 3")
def peers_comparable(spark: SparkSession, d: str) -> DataFrame:
    return views.comparable(robust.summaries(layers._rates(spark, d))).select("entity", "period", "modified_z")


@query(CAP + ", k AS (SELECT entity, period, list(DISTINCT concept) AS have FROM x GROUP BY ALL) SELECT entity, period, array_to_string(list_sort(list_intersect(['ESCALATION_STATUS','SECURITY_SEVERITY','NETWORK_ZONE'], have)), ',') AS evidenced, array_to_string(list_sort(list_filter(['ESCALATION_STATUS','SECURITY_SEVERITY','NETWORK_ZONE'], lambda c: NOT list_contains(have, c))), ',') AS unresolved FROM k")
def peer_concepts(spark: SparkSession, d: str) -> DataFrame:
    return robust.concept_evidence(layers._capable(spark, d)[0], ["ESCALATION_STATUS", "SECURITY_SEVERITY", "NETWORK_ZONE"])


# --- joins of the star schema ------------------------------------------------------------------


@query("SELECT o_orderkey AS alert, l_linenumber AS line, l_quantity AS quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey")
def join_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("alert"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    return relations.with_cases(table(spark, d, "orders").select(F.col("o_orderkey").alias("alert")), cases, "alert", ["line", "quantity"])


@query("SELECT l_orderkey, l_linenumber, p_brand AS brand, p_size AS size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def join_assets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return relations.with_asset(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("asset")), part, "asset", ["brand", "size"]).drop("asset")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) AS anomalous FROM orders")
def join_flagged(spark: SparkSession, d: str) -> DataFrame:
    odd = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.flag_members(table(spark, d, "orders").select("o_orderkey"), odd, "o_orderkey", "anomalous")


@query("SELECT n_name AS entity, r_name AS region_name, customers AS size_customers, suppliers AS size2_suppliers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join_report(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    base = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("entity"), F.col("r_name").alias("name"), "n_nationkey")
    count = lambda t, key, name: base.select("entity", "n_nationkey").join(table(spark, d, t), F.col("n_nationkey") == F.col(key)).groupBy("entity").agg(F.count("*").alias(name))
    return views.report_rows({"region": base.drop("n_nationkey"), "size": count("customer", "c_nationkey", "customers"), "size2": count("supplier", "s_nationkey", "suppliers")})


@query("SELECT l_orderkey, l_linenumber, CAST(l_tax = 0 AS INTEGER) AS untaxed, CAST(l_returnflag = 'R' AND l_discount > 0.05 AS INTEGER) AS returned_at_discount, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 0 END AS flag_score FROM lineitem")
def record_flags(spark: SparkSession, d: str) -> DataFrame:
    t = flags.flags(table(spark, d, "lineitem"), {"untaxed": F.col("l_tax") == 0, "returned_at_discount": (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)})
    return t.select("l_orderkey", "l_linenumber", "untaxed", "returned_at_discount", flags.score(F.col("l_returnflag"), {"R": 3, "A": 2}).alias("flag_score"))


@query("SELECT c_custkey AS asset, 'silent_large' AS finding FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'in_debt' FROM customer WHERE c_acctbal < 0")
def blind_spots(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").withColumn("asset", F.col("c_custkey")), table(spark, d, "orders").select(F.col("o_custkey").alias("asset"))
    return flags.findings({"silent_large": flags.silent(c, o, "asset", F.col("c_acctbal") > 5000), "in_debt": c.where("c_acctbal < 0")}, "asset")


@query("SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' END) AS drivers FROM part")
def part_drivers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", flags.drivers([(F.col("p_size") > 40, "large"), (F.col("p_retailprice") > 1500, "dear"), (F.contains("p_type", F.lit("STEEL")), "steel")]).alias("drivers"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT row_id, coalesce(CASE WHEN coalesce(host, '') <> '' THEN host END, 'UNKNOWN_ENTITY') AS entity, CASE WHEN coalesce(host, '') <> '' THEN 0.3 ELSE 0.0 END AS confidence, CASE WHEN coalesce(host, '') <> '' THEN 'host' END AS source FROM dataset_capability_rich")
def entity_legacy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_capability_rich").select("row_id", "host")
    return t.select("row_id", scopes.legacy_entity(t).alias("e")).select("row_id", "e.*")


# --- profiles and listings -------------------------------------------------------------------


@query("WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus IS NULL) AS a, count(*) FILTER (WHERE o_totalprice IS NULL) AS b FROM orders) SELECT n AS records, CAST(2 AS BIGINT) AS columns, round((a / n + b / n) / 2 * 100, 2) AS missing_percent FROM t")
def profile_dataset(spark: SparkSession, d: str) -> DataFrame:
    return profile.dataset_profile(profile.inventory(table(spark, d, "orders"), ["o_orderstatus", "o_totalprice"]))


@query("WITH v AS (SELECT alert_id AS value, count(*) AS n FROM alert_context WHERE alert_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1), r AS (SELECT * FROM v ORDER BY n DESC, value LIMIT 10) SELECT (SELECT string_agg(value, ',' ORDER BY n DESC, value) FROM r) AS values, (SELECT count(*) FROM v) > 10 AS truncated")
def profile_top_repeats(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_with_truncation(table(spark, d, "alert_context"), "alert_id", 10).withColumn("values", F.array_join("values", ","))


@query("WITH v AS (SELECT DISTINCT category AS value FROM alert_context WHERE category IS NOT NULL) SELECT (SELECT string_agg(value, ',' ORDER BY value) FROM (SELECT value FROM v ORDER BY value LIMIT 3)) AS values, (SELECT count(*) FROM v) > 3 AS truncated")
def profile_first_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_with_truncation(table(spark, d, "alert_context"), "category", 3).withColumn("values", F.array_join("values", ","))


@query("WITH v AS (SELECT DISTINCT alert_id FROM alert_context WHERE alert_id IS NOT NULL) SELECT (SELECT count(*) FROM v) AS n, (SELECT string_agg(alert_id, ',' ORDER BY alert_id) FROM (SELECT alert_id FROM v ORDER BY 1 LIMIT 50)) AS first_values, (SELECT count(*) FROM v) > 50 AS truncated")
def capped_alerts(spark: SparkSession, d: str) -> DataFrame:
    return relations.capped(table(spark, d, "alert_context").where("alert_id IS NOT NULL").select("alert_id").distinct(), "alert_id").withColumn("first_values", F.array_join("first_values", ","))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey")
def batched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows read in batches by the driver-side iterator and given back as a frame."""
    rows = [(r["o_orderkey"], r["o_totalprice"]) for part in filters.batches(table(spark, d, "orders"), ["o_totalprice"], "o_orderkey", 500, [("o_orderstatus", "eq", "P")]) for r in part]
    return spark.createDataFrame(rows, table(spark, d, "orders").select("o_orderkey", "o_totalprice").schema)


@query("SELECT cse AS entity, period, row_id AS position FROM dataset_multi_cse WHERE upper(regexp_replace(regexp_replace(trim(host, ' '), '[ .\\-/]', '_', 'g'), '_+', '_', 'g')) = (SELECT upper(replace(min(host), '-', '_')) FROM dataset_multi_cse WHERE regexp_full_match(host, '[A-Z]+-[0-9]+'))")
def group_positions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_multi_cse").withColumn("entity", F.col("cse"))
    named = t.where(F.col("host").rlike(r"^[A-Z]+-[0-9]+\z")).agg(F.min("host").alias("h")).first()["h"]
    return patterns.group_positions(t, "host", named or "", "row_id")


# --- texts ---------------------------------------------------------------------------------


@query("SELECT DISTINCT l_linenumber + o AS n, (l_linenumber + o) || CASE WHEN (l_linenumber + o) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (l_linenumber + o) % 10 = 1 THEN 'st' WHEN (l_linenumber + o) % 10 = 2 THEN 'nd' WHEN (l_linenumber + o) % 10 = 3 THEN 'rd' ELSE 'th' END AS text FROM lineitem, (VALUES (0), (10), (20), (110)) AS t(o)")
def text_ordinals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select(F.explode(F.transform(F.array(*map(F.lit, (0, 10, 20, 110))), lambda o: F.col("l_linenumber") + o)).alias("n")).distinct()
    return n.select("n", texts.ordinal(F.col("n")).alias("text"))


@query("WITH p AS (SELECT o_orderkey, -(o_orderkey % 90) / 10.0 AS l FROM orders) SELECT o_orderkey, CASE WHEN l <= -4 THEN 'about 1 in 10^' || CAST(floor(-l) AS BIGINT) ELSE printf('%.4f', pow(10, l)) END AS phrase, CASE WHEN pow(10, l) < 1e-4 THEN 0.0 ELSE round(pow(10, l), 6) END AS shown FROM p")
def text_probabilities(spark: SparkSession, d: str) -> DataFrame:
    log10 = -(F.col("o_orderkey") % 90) / F.lit(10.0)
    return table(spark, d, "orders").select("o_orderkey", texts.probability_phrase(log10).alias("phrase"), texts.shown_probability(F.pow(F.lit(10.0), log10)).alias("shown"))


@query("SELECT n_nationkey, 'Nation ' || n_name || ' (region ' || n_regionkey || ')' AS text FROM nation")
def text_templates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    return t.select("n_nationkey", texts.template("Nation {n_name} (region {n_regionkey})", t.columns).alias("text"))


@query(r"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(upper(p_name), '[,;\s]+'), lambda x: x <> ''), '|') AS tokens FROM part")
def text_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(texts.listed(F.col("p_name")), "|").alias("tokens"))


# --- concepts and mapping --------------------------------------------------------------------


@query("SELECT row_id, f AS feature, len(miss) = 0 AS available, array_to_string(miss, ',') AS missing FROM (SELECT row_id, 'FAST_CLOSURE_RISK' AS f, list_filter([CASE WHEN created_time IS NULL THEN 'EVENT_TIMESTAMP' END, CASE WHEN closed_time IS NULL THEN 'RESOLUTION_TIME' END], lambda x: x IS NOT NULL) AS miss FROM dataset_capability_rich UNION ALL SELECT row_id, 'SEVERITY_RISK', list_filter([CASE WHEN priority IS NULL THEN 'SECURITY_SEVERITY' END], lambda x: x IS NOT NULL) FROM dataset_capability_rich UNION ALL SELECT row_id, 'INVESTIGATION_QUALITY', list_filter([CASE WHEN investigation_notes IS NULL THEN 'INVESTIGATION_EVIDENCE' END], lambda x: x IS NOT NULL) FROM dataset_capability_rich UNION ALL SELECT row_id, 'ESCALATION_GAP', list_filter([CASE WHEN escalation_status IS NULL THEN 'ESCALATION_STATUS' END, CASE WHEN priority IS NULL THEN 'SECURITY_SEVERITY' END], lambda x: x IS NOT NULL) FROM dataset_capability_rich UNION ALL SELECT row_id, 'ASSET_CRITICALITY_RISK', ['ASSET_CRITICALITY'] FROM dataset_capability_rich UNION ALL SELECT row_id, 'MONITORING_VISIBILITY_GAP', list_filter([CASE WHEN telemetry_available IS NULL THEN 'EXPECTED_TELEMETRY' END], lambda x: x IS NOT NULL) FROM dataset_capability_rich)")
def feature_availability(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_capability_rich").select("row_id", *[F.col(c).alias(k) for k, c in layers.CONCEPTS.items()])
    return concepts.feature_availability(t, "row_id", list(layers.CONCEPTS))


@query("SELECT * FROM (VALUES ('ALERTS', 'SECURITY_SEVERITY'), ('ALERTS', 'ALERT_ID'), ('ALERTS', 'TRIGGERED_AT'), ('CASES', 'CASE_ID'), ('WORKFLOW_EVENTS', 'WORKFLOW_CASE_ID')) AS t(role, concept)")
def required_concepts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r, c) for r in ("ALERTS", "CASES", "WORKFLOW_EVENTS", "ASSETS", "UNKNOWN") for c in concepts.required_for(r)], "role string, concept string")


def _decisions(spark: SparkSession, d: str) -> list:
    return mapping.decide(profile.profile_rows(table(spark, d, "dataset_multi_cse").drop("received_at"), "row_id"))


@query("SELECT * FROM (VALUES ('alert_id', 'ALERT_ID', true), ('priority', 'SECURITY_SEVERITY', true), ('host', 'ASSET_IDENTIFIER', true), ('created_time', 'EVENT_TIMESTAMP', true), ('investigation_notes', 'INVESTIGATION_EVIDENCE', true)) AS t(column_name, concept, applied)")
def mapping_applied(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x.column, x.concept, x.applied) for x in _decisions(spark, d) if x.applied], "column_name string, concept string, applied boolean")


_LEAF = r"CASE WHEN lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')) NOT IN ('','nan') THEN {c} END"


@query(f"SELECT row_id, {_LEAF.format(c='priority')} AS severity, {_LEAF.format(c='alert_id')} AS alert_id, {_LEAF.format(c='investigation_notes')} AS notes, {_LEAF.format(c='investigation_notes')} IS NOT NULL AS available FROM dataset_multi_cse")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as nested sections, some of their leaves taken out again."""
    nested = mapping.canonical(table(spark, d, "dataset_multi_cse"), _decisions(spark, d), ("row_id",))
    return nested.select("row_id", "alert_context.severity", "alert_context.alert_id", "investigation_context.notes", "investigation_context.available")


# --- agreement checks ----------------------------------------------------------------------


@query(REC + f" SELECT entity, period, row_ordinal FROM rec WHERE {STATE_SQL} = 'EXPECTATION_VIOLATED' AND entity = 'NATION_1'")
def agree_untraceable(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return agreement.untraceable(rules.gap_findings(r, GAP).select("entity", "period", "row_ordinal"), r.where("entity <> 'NATION_1'"))


@query(ABS_SQL + " SELECT entity, period FROM a WHERE triggered > 0 AND entity = 'NATION_2'")
def agree_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Measures of which one entity's coverage is off by more than the tolerance."""
    m = rules.absence_measures(records(spark, d), layers.ABSENCE)
    off = F.when(F.col("entity") == "NATION_2", F.col("coverage") + 0.0002).otherwise(F.col("coverage") + 0.00004)
    return agreement.wrong_arithmetic(m.withColumn("coverage", off)).select("entity", "period")


@query(REC + " SELECT entity, period, row_ordinal, 'CRITICAL' AS value FROM rec WHERE amount > 400000 AND severity IS DISTINCT FROM 'CRITICAL'")
def agree_values(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return agreement.unsupported_values(r.where("amount > 400000").select("entity", "period", "row_ordinal", F.lit("CRITICAL").alias("value")), r, "severity")


@query(REC + ", n AS (SELECT entity, period, count(*) AS scope_count FROM rec GROUP BY ALL), g AS (SELECT entity, period, segment, count(*) AS c, min(row_ordinal) AS f FROM rec GROUP BY ALL), b AS (SELECT entity, period, first(segment ORDER BY c DESC, f) AS group_value, max(c) AS group_count FROM g GROUP BY ALL) SELECT entity, period, group_value, group_count, scope_count, group_count AS found_cited, group_count AS found_sharing, scope_count AS found_scope, true AS shares_value, true AS count_matches, true AS population_matches FROM n JOIN b USING (entity, period)")
def agree_operational(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the concentration method checked against the records they cite: all must hold."""
    r = records(spark, d)
    c = patterns.concentration(r, "segment", "row_ordinal").select("entity", "period", F.col("busiest").alias("group_value"), F.col("k_busiest").alias("group_count"), F.col("n_records").alias("scope_count"))
    cited = r.join(c, ["entity", "period"]).where(F.upper("segment") == F.col("group_value")).select("entity", "period", "row_ordinal")
    return agreement.operational(c, cited, r, "segment")


@query("SELECT * FROM (VALUES ('SECURITY_SEVERITY', 'priority,severity')) AS t(concept, columns)")
def agree_collisions(spark: SparkSession, d: str) -> DataFrame:
    return agreement.collisions(spark.createDataFrame([("severity", "SECURITY_SEVERITY"), ("priority", "SECURITY_SEVERITY"), ("host", "ASSET_IDENTIFIER"), ("x", None)], "column string, concept string"))


@query(REC + ", n AS (SELECT entity, period, count(*) AS c FROM rec GROUP BY ALL) SELECT entity, period, CAST(c < 24 AS BIGINT) AS declined, CAST(c < 22 AS BIGINT) AS expected, CASE WHEN c < 22 THEN true END AS agrees FROM n WHERE c < 24")
def agree_declined(spark: SparkSession, d: str) -> DataFrame:
    n = scopes.scope_counts(records(spark, d))
    below = lambda k: n.where(F.col("records") < k).select("entity", "period", F.lit("concentration").alias("pattern"))
    return agreement.declined(below(24), below(22))


@query(layers.AGREE + " SELECT coalesce(e.entity, h.entity) AS entity, coalesce(e.period, h.period) AS period, 'execution_gap' AS family, CASE WHEN e.entity IS NOT NULL AND h.entity IS NOT NULL THEN CASE WHEN e.entity < 'NATION_2' THEN 'MATCH' ELSE 'MATCH_UNSUPPORTED' END WHEN e.entity IS NOT NULL AND e.entity IN (SELECT entity FROM h) THEN 'SCOPE_MISMATCH' WHEN h.entity IS NOT NULL AND h.entity IN (SELECT entity FROM e) THEN 'SCOPE_MISMATCH' WHEN e.entity IS NOT NULL THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS agreement FROM e FULL JOIN h ON e.entity = h.entity AND e.period = h.period")
def agree_supported(spark: SparkSession, d: str) -> DataFrame:
    e, h = layers._sides(spark, d)
    return agreement.compare(e.withColumn("supported", F.col("entity") < "NATION_2"), h)


@query(REC + " SELECT DISTINCT entity, period, f AS family, CAST(NULL AS VARCHAR) AS indicator, CAST(NULL AS VARCHAR) AS note FROM rec, (VALUES ('execution_gap'), ('negative_space')) AS t(f)")
def review_template(spark: SparkSession, d: str) -> DataFrame:
    return agreement.review_template(scopes.scope_counts(records(spark, d)), ["execution_gap", "negative_space"])


@query(REC + " SELECT row_ordinal FROM rec WHERE entity = 'NATION_5' AND period = '1995-Q2'")
def review_scope_rows(spark: SparkSession, d: str) -> DataFrame:
    return agreement.scope_rows(records(spark, d), "NATION_5", "1995-Q2")


# --- the whole assessment ----------------------------------------------------------------------


def _assessment(spark: SparkSession, d: str) -> Assessment:
    ensure_checkpoint_dir(spark)
    return Assessment(table(spark, d, "dataset_capability_rich").drop("received_at", "feed_id", "load_no"), order="row_id")


_TOK = r"coalesce(regexp_replace(upper(regexp_replace(regexp_replace(trim({c}, ' '), '[ .\-/]', '_', 'g'), '_+', '_', 'g')), '^_+|_+$', '', 'g'), '')"
_EVID = r"({c} IS NOT NULL AND upper(regexp_replace({c}, '^\s+|\s+$', '', 'g')) NOT IN ('','NAN','N/A','NA','NONE','NULL','NIL','-','--','UNKNOWN'))"
_POP = r"CASE WHEN lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')) NOT IN ('','nan','nat','none','null') THEN regexp_replace({c}, '^\s+|\s+$', '', 'g') END"
ASSESS = f"WITH ar AS (SELECT row_id AS row_ordinal, coalesce({_POP.format(c='cse')}, 'UNKNOWN_ENTITY') AS entity, coalesce({_POP.format(c='period')}, 'UNKNOWN_PERIOD') AS period, {_TOK.format(c='priority')} AS sev, {_TOK.format(c='escalation_status')} AS esc, {_EVID.format(c='priority')} AND {_EVID.format(c='escalation_status')} AS ok, {_EVID.format(c='escalation_status')} AS has FROM dataset_capability_rich)"


@query(ASSESS + " SELECT row_ordinal, entity, period FROM ar WHERE ok AND sev = 'CRITICAL' AND esc = 'NOT_ESCALATED'")
def assessment_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _assessment(spark, d).gap_findings().select("row_ordinal", "entity", "period")


@query(ASSESS + ", m AS (SELECT entity, period, count(*) AS records, count(*) FILTER (WHERE sev = 'CRITICAL') AS triggered, count(*) FILTER (WHERE sev = 'CRITICAL' AND has AND esc IN ('ESCALATED','NOT_ESCALATED')) AS with_evidence FROM ar GROUP BY ALL) SELECT entity, period, records, triggered, with_evidence, triggered - with_evidence AS without_evidence FROM m")
def assessment_absences(spark: SparkSession, d: str) -> DataFrame:
    return _assessment(spark, d).absence_measures().select("entity", "period", "records", "triggered", "with_evidence", "without_evidence")


@query(ASSESS + " SELECT entity, period, 'execution_gap_incidence' AS metric, round(count(*) FILTER (WHERE ok AND sev = 'CRITICAL' AND esc = 'NOT_ESCALATED') / count(*), 6) AS rate FROM ar GROUP BY entity, period")
def assessment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _assessment(spark, d).metrics().where("metric = 'execution_gap_incidence'").select("entity", "period", "metric", "rate")


@query(ASSESS + ", r AS (SELECT entity, period, round(count(*) FILTER (WHERE ok AND sev = 'CRITICAL' AND esc = 'NOT_ESCALATED') / count(*), 6) AS rate FROM ar GROUP BY entity, period) SELECT t.entity, t.period, 'execution_gap_incidence' AS metric, count(*) AS peers, round(quantile_cont(p.rate, 0.5) + 1e-9, 6) AS median, count(*) FILTER (WHERE p.rate < t.rate) + 1 AS rank FROM r t JOIN r p ON t.period = p.period AND t.entity <> p.entity GROUP BY t.entity, t.period, t.rate")
def assessment_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _assessment(spark, d).benchmark().where("metric = 'execution_gap_incidence'").select("entity", "period", "metric", "peers", "median", "rank")


@query(ASSESS + " SELECT entity, period, count(*) AS records FROM ar GROUP BY ALL")
def assessment_scopes(spark: SparkSession, d: str) -> DataFrame:
    return _assessment(spark, d).scopes


@query("SELECT * FROM (VALUES ('absences'), ('anomalies'), ('benchmark'), ('capabilities'), ('concentration'), ('findings'), ('metrics'), ('package'), ('repetition'), ('scopes')) AS t(layer)")
def assessment_layers(spark: SparkSession, d: str) -> DataFrame:
    """Names of the layers that ran; one that could not would be missing."""
    done = _assessment(spark, d).run()
    return spark.createDataFrame([(k,) for k, v in done.items() if v is not None and not (isinstance(v, dict) and v.get("status") in ("UNAVAILABLE", "FAILED"))], "layer string")


@query(REC + ", e AS (SELECT entity, count(*) AS n FROM rec GROUP BY 1) SELECT entity, CASE WHEN n >= 650 THEN 'HIGH' WHEN n >= 600 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM e WHERE n >= 600")
def entities_by_priority(spark: SparkSession, d: str) -> DataFrame:
    e = records(spark, d).groupBy("entity").agg(F.count("*").alias("n")).withColumn("band", scoring.banded(F.col("n"), [(650, "HIGH"), (600, "MEDIUM")], "LOW"))
    return views.by_priority(e, "n", "band", "LOW").select("entity", "band")


# --- configuration, names, small pieces ----------------------------------------------------------


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("SELECT * FROM (VALUES ('host', 'THREAT_CATEGORY', 'applied'), ('priority', 'ALERT_ID', 'another column holds this place'), ('nothing', 'ALERT_ID', 'no such column'), ('period', 'NO_CONCEPT', 'no such concept'), ('closed_by', 'RESOLUTION_TIME', 'names an actor, not a time')) AS t(column_name, concept, outcome)")
def mapping_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer's choices: applied, or rejected with the reason."""
    rows = profile.profile_rows(table(spark, d, "dataset_multi_cse").drop("received_at").withColumn("closed_by", F.lit("ann.a")), "row_id")
    wanted = {"host": "THREAT_CATEGORY", "priority": "ALERT_ID", "nothing": "ALERT_ID", "period": "NO_CONCEPT", "closed_by": "RESOLUTION_TIME"}
    done, rejected = mapping.override(mapping.decide(rows), wanted)
    held = {x.column: x.concept for x in done if x.applied}
    return _listed(spark, [(c, w, rejected.get(c, "applied" if held.get(c) == w else "lost")) for c, w in wanted.items()], "column_name string, concept string, outcome string")


@query("SELECT * FROM (VALUES ('alert_context', 'ALERTS'), ('case_context', 'CASES'), ('region', 'UNKNOWN')) AS t(name, role)")
def mapping_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, key in (("alert_context", "row_id"), ("case_context", "row_id"), ("region", "r_regionkey")):
        t = table(spark, d, name)
        t = t.select(*[F.col(c).cast("string").alias(c) if k.startswith("timestamp") else F.col(c) for c, k in t.dtypes])
        rows.append((name, mapping.role(mapping.decide(profile.profile_rows(t, key)))[0]))
    return _listed(spark, rows, "name string, role string")


@query("SELECT row_id, alert_id AS \"ALERT_ID\", priority AS \"SECURITY_SEVERITY\", host AS \"ASSET_IDENTIFIER\", created_time AS \"EVENT_TIMESTAMP\", investigation_notes AS \"INVESTIGATION_EVIDENCE\" FROM dataset_multi_cse")
def mapping_projection(spark: SparkSession, d: str) -> DataFrame:
    ds, t = _decisions(spark, d), table(spark, d, "dataset_multi_cse")
    p = mapping.project(t.withColumn("_row", F.col("row_id")), ds).columns
    return t.select("row_id", *[F.col(next(x.column for x in ds if x.applied and x.concept == c)).alias(c) for c in p])


@query("SELECT p_partkey, 'P' AS period FROM part")
def period_inherited(spark: SparkSession, d: str) -> DataFrame:
    """One label in the whole table: rows without one inherit it."""
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.lit("P")).alias("label"))
    return scopes.with_period(t, "label").select("p_partkey", "period")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'EVEN' ELSE 'UNKNOWN_PERIOD' END AS period FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'THIRD' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    """Several labels: rows without one have no known period."""
    label = F.when(F.col("c_custkey") % 2 == 0, "EVEN").when(F.col("c_custkey") % 3 == 0, "THIRD")
    return scopes.with_period(table(spark, d, "customer").select("c_custkey", label.alias("label")), "label").select("c_custkey", "period")


@query("SELECT * FROM (VALUES ('plain.csv', 'plain.csv'), ('a b.csv', 'a_b.csv-' || left(sha256('a b.csv'), 8)), ('x/../y.csv', 'y.csv-' || left(sha256('x/../y.csv'), 8))) AS t(name, safe)")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, [(n, integrity.safe_name(n)) for n in ("plain.csv", "a b.csv", "x/../y.csv")], "name string, safe string")


@query("SELECT 'EV-20260102T030405Z-' || left(sha256('x'), 12) AS evidence_id, sha256('{\"a\": 1, \"b\": [2]}') AS fingerprint")
def evidence_names(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt
    import hashlib

    at = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    return _listed(spark, [(integrity.evidence_id("EV", hashlib.sha256(b"x").hexdigest(), at), texts.fingerprint({"b": [2], "a": 1}))], "evidence_id string, fingerprint string")


@query("SELECT * FROM (VALUES ('alert_management', 0.5), ('investigation', 1.0), ('assets', 0.5), ('network', 0.0)) AS t(area, share)")
def dataset_context(spark: SparkSession, d: str) -> DataFrame:
    c = concepts.context(["SECURITY_SEVERITY", "INVESTIGATION_EVIDENCE", "ESCALATION_STATUS", "ASSET_IDENTIFIER"])
    return _listed(spark, list(c.items()), "area string, share double")


@query("SELECT * FROM (VALUES ('repeated ids'), ('unknown concept'), ('operator'), ('capability: T: unknown concept NO_SUCH'), ('capability: T: its least evidence cannot be met'), ('capability: T: repeated'), ('model: unknown feature z'), ('model: contamination must be a number in (0, 0.5]')) AS t(problem)")
def configuration_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a faulty configuration is refused for."""
    found = []
    good = layers.GAP
    for rules_, name in (([good, good], "repeated ids"), ([rules.GapRule("r", ("nothing",), (), ())], "unknown concept")):
        try:
            rules.validate(rules_, ["severity", "escalation"])
        except ValueError:
            found.append(name)
    try:
        rules.Condition("severity", "like", ("x",))
    except ValueError:
        found.append("operator")
    bad = [capability.Capability("T", ("NO_SUCH",), (), 2, 2), capability.Capability("T", ("SECURITY_SEVERITY",), (), 1, 1)]
    found += [f"capability: {x}" for x in capability.check_registry(bad, set(concepts.PATHS))]
    found += [f"model: {x}" for x in forest.check_config({"features": ["z"], "contamination": "auto"}, ["a"])]
    return _listed(spark, [(x,) for x in found], "problem string")


@query("SELECT 'root_cause_identified' AS column_name, 'numeric' AS kind, count(DISTINCT root_cause_identified) AS unique_values, count(*) - count(root_cause_identified) AS null_values, count(*) AS total_rows, CAST(min(CAST(root_cause_identified AS INTEGER)) AS DOUBLE) AS min, CAST(max(CAST(root_cause_identified AS INTEGER)) AS DOUBLE) AS max, round(avg(CAST(root_cause_identified AS INTEGER)), 4) AS mean, round(coalesce(stddev_samp(CAST(root_cause_identified AS INTEGER)), 0), 4) AS std FROM dataset_capability_rich")
def profile_boolean(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(table(spark, d, "dataset_capability_rich"), ["root_cause_identified"])


@query(RATE_SQL + ", q AS (SELECT sector, quantile_cont(rate, 0.5) AS md, quantile_cont(rate, 0.1) AS a, quantile_cont(rate, 0.9) AS z FROM m GROUP BY 1) SELECT entity, period, round(CASE WHEN z > a THEN abs(rate - md) / (z - a) ELSE 0 END + 1e-9, 6) AS distance FROM m JOIN q USING (sector)")
def robust_distances(spark: SparkSession, d: str) -> DataFrame:
    m = layers._rates(spark, d)
    q = m.groupBy("sector").agg(F.percentile("rate", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("q"))
    return m.join(q, "sector").select("entity", "period", robust.r6(robust.robust_distance(F.col("rate"), F.col("q")[0], F.col("q")[1], F.col("q")[2])).alias("distance"))


@query(layers.ORACLE["fx_features"].replace("SELECT * FROM b LEFT JOIN e", "SELECT entity, period, CAST(scope_record_count AS DOUBLE) AS scope_record_count, critical_share FROM b LEFT JOIN e") + " WHERE critical_share IS NOT NULL")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return features.matrix(features.scope_features(records(spark, d)), ["scope_record_count", "critical_share"])


@query("SELECT true AS same_nodes, true AS same_digest, true AS refuses_changes")
def forest_saved(spark: SparkSession, d: str) -> DataFrame:
    """A forest written and read again; a changed one is refused."""
    import uuid

    ensure_checkpoint_dir(spark)
    f = features.scope_features(records(spark, d)).checkpoint()
    nodes = forest.train(f, layers.FEATURES, ["entity", "period"], trees=5).checkpoint()
    to = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/forest-{uuid.uuid4().hex}"
    digest = forest.save(nodes, to, {"features": layers.FEATURES})
    back, meta = forest.load(spark, to)
    same = back.exceptAll(nodes).isEmpty() and nodes.exceptAll(back).isEmpty()
    nodes.limit(0).write.mode("overwrite").parquet(f"{to}/nodes")
    try:
        forest.load(spark, to)
        refused = False
    except ValueError:
        refused = True
    return _listed(spark, [(same, meta["sha256"] == digest, refused)], "same_nodes boolean, same_digest boolean, refuses_changes boolean")
