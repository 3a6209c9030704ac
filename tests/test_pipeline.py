"""The whole assessment over small files, evidence register, read models."""

import os

import pytest
from pyspark.sql import functions as F

from auditlake.operators import metrics, rules, views
from auditlake.operators.evidence import Register
from auditlake.plans.pipeline import Assessment, rules_from

HEADER = "cse,period,alert_id,priority,escalation_status,host,investigation_notes"
LINES = [
    "E1,P1,ALRT-1,CRITICAL,NOT_ESCALATED,DB-01,looked at the host and closed it",
    "E1,P1,ALRT-2,CRITICAL,ESCALATED,DB-02,looked at the host and closed it",
    "E1,P1,ALRT-3,LOW,,DB-03,other words were written down here",
    "E2,P1,ALRT-4,critical,n/a,DB-01,",
    "E2,P1,ALRT-5,HIGH,ESCALATED,DB-01,nothing of note was found at all",
    "E3,P2,ALRT-6,LOW,NOT ESCALATED,DB-01,nothing of note was found at all",
]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    p = tmp_path_factory.mktemp("in") / "a.csv"
    p.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(p)


def test_end_to_end(spark, source):
    r = Assessment.of(spark, source).run()
    assert not [k for k, v in r.items() if isinstance(v, dict) and v.get("status") == "UNAVAILABLE" and k != "anomalies"]
    assert r["anomalies"]["reason"].startswith("too few")
    assert r["package"]["role"] == "ALERTS"
    f = r["findings"].collect()
    assert sorted((x.family, x.entity) for x in f) == [("execution_gap", "E1"), ("negative_space", "E2")]
    assert {x.entity: x.state for x in r["absences"].collect()} == {"E1": rules.NO_ABSENCE, "E2": rules.COMPLETE, "E3": rules.NOT_TRIGGERED}
    m = {(x.entity, x.metric): x for x in r["metrics"].collect()}
    assert m["E1", "execution_gap_incidence"].rate == pytest.approx(1 / 3, abs=1e-6)
    assert (m["E3", "negative_space_incidence"].rate, m["E3", "negative_space_incidence"].metric_status) == (None, metrics.NOT_EVALUABLE)
    assert r["repetition"].count() == 3 and r["concentration"].count() == 3 and r["benchmark"].count() > 0


def test_renamed_columns_give_the_same_findings(spark, source, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("\n".join(["operating_unit,reporting_window,alert_id,severity,referral_state,hostname,analyst_remarks", *LINES]) + "\n")
    pick = lambda a: sorted((x.family, x.entity, x.period) for x in a.findings().collect())
    assert pick(Assessment.of(spark, source)) == pick(Assessment.of(spark, str(p)))


def test_rows_in_another_order_give_the_same_findings(spark, source, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("\n".join([HEADER, *reversed(LINES)]) + "\n")
    pick = lambda a: sorted((x.entity, x.violated) for x in rules.gap_counts(a.concepts, a.gaps[0]).collect())
    assert pick(Assessment.of(spark, source)) == pick(Assessment.of(spark, str(p)))


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        rules_from({"gaps": [{"id": "x", "required": [], "violation": [{"concept": "A", "op": "near", "values": ["x"]}]}]})


def test_views(spark, source):
    a = Assessment.of(spark, source)
    rows = views.entity_rows(a.findings(), a.scopes, ["execution_gap", "negative_space"])
    got = {r.entity: (r.signals, r.leading_family) for r in rows.collect()}
    assert got == {"E1": (1, "execution_gap"), "E2": (1, "negative_space"), "E3": (0, None)}
    assert [r.entity for r in views.ranked_entities(rows).collect()] == ["E1", "E2", "E3"]
    assert [r.family for r in views.review_samples(a.findings(), ["negative_space", "execution_gap"]).collect()] == ["execution_gap", "negative_space"]
    assert [r.entity for r in views.options(a.scopes, "entity").collect()] == ["E1", "E2", "E3"]
    m = views.benchmark_matrix(a.benchmark(), ["execution_gap_incidence"])
    assert m.columns == ["entity", "period", "execution_gap_incidence"]


def test_register(tmp_path):
    src = tmp_path / "a b.csv"
    src.write_text("x\n1\n")
    r = Register(str(tmp_path / "reg"))
    e = r.intake(str(src))
    assert r.intake(str(src))["evidence_id"] == e["evidence_id"] and len(r.entries()) == 1
    assert set(r.status(e["evidence_id"]).values()) == {"VERIFIED"}
    assert os.path.exists(r.open_for_analysis(e["evidence_id"]))
    with open(e["working"], "a") as f:
        f.write("2\n")
    with pytest.raises(ValueError):
        r.open_for_analysis(e["evidence_id"])
    assert [c["event"] for c in r.get(e["evidence_id"])["custody"]] == ["intake", "offered again", "opened", "refused"]


def test_flagged_incidence_counts_records_once(spark):
    s = spark.createDataFrame([("e", "p", 4)], "entity string, period string, records bigint")
    f = spark.createDataFrame([("e", "p", 1), ("e", "p", 1), ("e", "p", 2)], "entity string, period string, row_ordinal bigint")
    assert metrics.flagged_incidence(s, f, "m").select(F.col("rate")).first()[0] == 0.5


def test_concepts(spark):
    from auditlake.operators import concepts

    assert concepts.required_for("ALERTS") == ["SECURITY_SEVERITY", "ALERT_ID", "TRIGGERED_AT"] and concepts.required_for("UNKNOWN") == []
    assert concepts.missing_required("ALERTS", ["ALERT_ID", "EVENT_TIMESTAMP"]) == ["SECURITY_SEVERITY"]
    assert "ASSET_TYPE" in concepts.for_pipeline("WORKFLOW")
    df = spark.createDataFrame([(1, "HIGH", None)], "k int, SECURITY_SEVERITY string, ESCALATION_STATUS string")
    got = {r.feature: (r.available, r.missing) for r in concepts.feature_availability(df, "k", ["SECURITY_SEVERITY", "ESCALATION_STATUS"]).collect()}
    assert got["SEVERITY_RISK"] == (True, "") and got["ESCALATION_GAP"] == (False, "ESCALATION_STATUS") and got["FAST_CLOSURE_RISK"] == (False, "EVENT_TIMESTAMP,RESOLUTION_TIME")
    assert concepts.concept_frame(spark).count() == len(concepts.CONCEPTS)
    assert concepts.context(["SECURITY_SEVERITY", "RESOLUTION_TIME", "ASSET_IDENTIFIER"]) == {"alert_management": 1.0, "investigation": 0.0, "assets": 0.5, "network": 0.0}
