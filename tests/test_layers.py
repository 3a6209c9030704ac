"""Record layers: predicates, rules, capabilities, similarity, peers, features, forest, scoring, agreement."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake import columns as C
from auditlake.functions import dates, vocabulary
from auditlake.operators import agreement, capability, features, filters, forest, mapping, patterns, profile, relations, robust, rules, scopes, scoring, similarity, validation


def values(spark, xs, e):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(e("x")).collect()]


@pytest.mark.parametrize(
    ("predicate", "false_for"),
    [(C.has_evidence, {None, "", " ", "N/A", "unknown", "-", "nan"}), (C.is_populated, {None, "", " ", "nan"}), (C.is_mappable, {None, "", " ", "nan"})],
)
def test_absence_predicates(spark, predicate, false_for):
    xs = [None, "", " ", "N/A", "unknown", "-", "nan", "x"]
    assert values(spark, xs, predicate) == [x not in false_for for x in xs]


def test_normalisers(spark):
    assert values(spark, ["not  escalated-x", None, " a/b.c ", "__"], C.norm_value) == ["NOT_ESCALATED_X", "", "A_B_C", ""]
    assert values(spark, [" A1 ", "n/a", None, "-"], C.norm_id) == ["A1", None, None, None]
    assert values(spark, ["Bb a-A 1", "", None, "é"], C.tokens) == [["1", "a", "bb"], None, None, None]
    assert values(spark, ["crit", "sev 2", "unknown", "odd", None], lambda c: vocabulary.canonical(c, "severity")) == ["CRITICAL", "HIGH", None, None, None]
    assert values(spark, ["03/04/2026", "2026-04-03T00:00:00Z", "x", None], lambda c: F.date_format(dates.parse(c), "yyyy-MM-dd")) == ["2026-04-03", "2026-04-03", None, None]


def recs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ordinal int, entity string, period string, severity string, escalation string, asset string, state string")


def test_gap_states(spark):
    rule = rules.GapRule("r", ("severity", "escalation"), (rules.Condition("severity", "in", ("CRITICAL",)), rules.Condition("escalation", "in", ("NOT_ESCALATED",))), (rules.Condition("escalation", "in", ("ESCALATED",)),))
    df = recs(spark, [("E", "P", s, e, "a", "x") for s, e in (("critical", "not escalated"), ("CRITICAL", "escalated"), ("LOW", "pending"), ("CRITICAL", "n/a"), (None, "ESCALATED"))])
    r = rules.gap_counts(df.drop("state"), rule).first()
    assert (r.records, r.violated, r.satisfied, r.not_applicable, r.not_evaluable) == (5, 1, 1, 1, 2)
    assert rules.gap_findings(df.drop("state"), rule).count() == 1
    with pytest.raises(ValueError):
        rules.validate([rule, rule], df.columns)
    with pytest.raises(ValueError):
        rules.validate([rule], ["severity"])
    with pytest.raises(ValueError):
        rules.Condition("severity", "like", ("x",))


def test_absence_states(spark):
    rule = rules.AbsenceRule("r", rules.Condition("severity", "in", ("CRITICAL",)), ("escalation",), {"escalation": ("ESCALATED", "NOT_ESCALATED")})
    df = recs(spark, [("A", "P", "CRITICAL", "N/A", "a", ""), ("B", "P", "CRITICAL", "ESCALATED", "a", ""), ("C", "P", "LOW", "x", "a", ""), ("D", "P", "CRITICAL", "ESCALATED", "a", ""), ("D", "P", "CRITICAL", "PENDING", "a", "")]).drop("state")
    m = {r.entity: r for r in rules.absence_measures(df, rule).collect()}
    assert {k: r.state for k, r in m.items()} == {"A": rules.COMPLETE, "B": rules.NO_ABSENCE, "C": rules.NOT_TRIGGERED, "D": rules.PARTIAL}
    assert (m["C"].coverage, m["D"].coverage, m["D"].unusable) == (None, 0.5, 1)
    assert rules.absence_findings(rules.absence_measures(df, rule), rule).count() == 2


def test_periods(spark):
    df = spark.createDataFrame([("a", "2026-01-05"), (None, "2026-03-01"), (" ", "bad")], "label string, t string")
    assert {r.period for r in scopes.with_period(df, "label").collect()} == {"a"}
    two = df.unionByName(spark.createDataFrame([("b", None)], "label string, t string"))
    assert {r.period for r in scopes.with_period(two, "label").collect()} == {"a", "b", scopes.UNKNOWN_PERIOD}
    assert {r.period for r in scopes.with_period(df, None, "t").collect()} == {"2026-01-05..2026-03-01", scopes.UNKNOWN_PERIOD}
    assert {r.period for r in scopes.with_period(df, None, "t", "quarter").collect()} == {"2026-Q1", scopes.UNKNOWN_PERIOD}


def test_capability(spark):
    df = spark.createDataFrame([("E", "P", 1, "HIGH", None), ("E", "P", 2, "LOW", "nan"), ("F", "P", 3, None, "h")], "entity string, period string, o int, sev string, host string")
    idx = capability.evidence_index(df, {"S": "sev", "H": "host"}, "o")
    assert {(r.entity, r.concept, r.populated, r.example) for r in idx.collect()} == {("E", "S", 2, "LOW"), ("F", "H", 1, "h")}
    caps = [capability.Capability("c", ("S",), ("H",), 1, 1), capability.Capability("d", ("S",), ("H",), 1, 2)]
    got = {(r.entity, r.capability): r.status for r in capability.evaluate(idx, df.select("entity", "period").distinct(), caps).collect()}
    assert got == {("E", "c"): "AVAILABLE", ("E", "d"): "INSUFFICIENT_EVIDENCE", ("F", "c"): "NOT_ASSESSED", ("F", "d"): "NOT_ASSESSED"}


def test_binomial_tail_is_exact(spark):
    df = spark.createDataFrame([("a", 20, 14, 7), ("b", 20, 3, 5), ("c", 5, 0, 3), ("d", 3, 3, 1)], "k string, n bigint, x bigint, g bigint")
    for r in patterns.binomial_tail(df, "n", "x", "g").collect():
        if r.g < 2:
            assert r.log10_tail is None
            continue
        p = Fraction(1, r.g)
        want = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.x, r.n + 1))
        assert r.log10_tail == pytest.approx(math.log10(want), abs=1e-9)


def test_concentration_and_repetition(spark):
    rows = [("E", "P", "LOW", "x", "a" if i < 14 else f"b{i % 6}", "") for i in range(20)] + [("F", "P", "LOW", "x", "a", "")] * 3 + [("F", "P", "LOW", "x", "b", "")]
    got = {r.entity: r for r in patterns.concentration(recs(spark, rows).drop("state"), "asset", "row_ordinal").collect()}
    assert (got["E"].status, got["E"].busiest, got["F"].status) == ("CONCENTRATION", "A", "NOT_EVALUABLE")
    texts = ["reviewed the alert and closed it today"] * 16 + [f"case {i} quite other words number{i * 7} z{i}" for i in range(10)]
    df = spark.createDataFrame([("E", i, t) for i, t in enumerate(texts)], "entity string, id int, text string")
    r = similarity.repetition(similarity.token_sets(df, ["entity"], "id", "text"), ["entity"], 0.8, 12, 3).first()
    assert (r.records, r.n_similar, r.component, r.status) == (26, 16, 0, "REPETITION")


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(1)
    sets = [sorted(rng.sample("abcdefghijklmnop", rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([("g", i, " ".join(s)) for i, s in enumerate(sets)], "g string, id int, text string")
    s = similarity.token_sets(df, ["g"], "id", "text")
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(tuple(x), i)
    ids = sorted(first.values())
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b) for a in ids for b in ids if a < b and jac(sets[a], sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in similarity.similar_pairs(s, ["g"], 0.6).collect()} == want
    best = {r.id: r.max_similarity for r in similarity.max_similarity(s, ["g"]).collect()}
    for a in ids:
        m = 1.0 if sum(x == sets[a] for x in sets) > 1 else max(jac(sets[a], sets[b]) for b in ids if b != a)
        assert best[a] == pytest.approx(m, abs=1e-6)
    assert similarity.similar_pairs(s.limit(0), ["g"], 0.6).count() == 0


def written(spark):
    """Shuffle bytes written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def notes(n, groups=("g",)):
    """Notes of one vocabulary, none twice, so that all pairs of a group share words."""
    rng = random.Random(5)
    return [(g, i, " ".join([f"own{i}", *(f"w{x}" for x in rng.sample(range(24), rng.randint(8, 14)))])) for i, g in zip(range(n), groups * n)]


def test_best_matches_stay_in_their_worker(spark):
    df = spark.createDataFrame(notes(1500), "g string, id int, text string")
    before = written(spark)
    assert len(similarity.max_similarity(similarity.token_sets(df, ["g"], "id", "text"), ["g"]).collect()) == 1500
    assert written(spark) - before < 1_000_000  # a row for each of the 1.1 million pairs takes more


def test_mean_best_match_stays_in_its_worker(spark, monkeypatch):
    df = spark.createDataFrame([(g, "P", i, t) for g, i, t in notes(1500)], "entity string, period string, row_ordinal int, text string")
    before = written(spark)
    (whole,) = features.mean_max_token_similarity(df, "text").collect()
    assert written(spark) - before < 1_000_000
    monkeypatch.setattr(similarity, "BLOCK", 400)
    assert features.mean_max_token_similarity(df, "text").collect() == [whole]


def test_mean_best_match_shuffles_less_than_its_texts(spark):
    rows = [(f"E{i % 5}", "P", i, t) for _, i, t in notes(6000)]
    before = written(spark)
    df = spark.createDataFrame(rows, "entity string, period string, row_ordinal int, text string")
    assert features.mean_max_token_similarity(df, "text").count() == 5
    assert written(spark) - before < sum(len(r[3]) for r in rows)


@pytest.mark.parametrize(("block", "pack"), [(32_768, 64 << 20), (7, 64 << 20), (32_768, 1), (7, 1)])
def test_equal_sets_of_several_tasks_are_one(spark, monkeypatch, block, pack):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PACK", pack)
    rng = random.Random(8)
    rows = [(rng.choice(["g", None]), f"r{i:03}", " ".join(rng.sample(["Aa", "b", "c1", "d", "e", "f", "g"], rng.randint(1, 6)))) for i in range(300)] + [("h", "x", "?"), ("h", "y", None), ("k", "z", "one")]
    df = spark.createDataFrame(rows, "g string, id string, text string").repartition(5)
    want = {}
    for g, i, t in rows:
        if t and any(c.isalnum() for c in t):
            want.setdefault((g, frozenset(t.lower().split())), []).append(i)
    jac = lambda a, b: len(a & b) / len(a | b)
    best = {(g, s): 1.0 if len(ids) > 1 else max((jac(s, x) for h, x in want if h == g and x != s), default=0.0) for (g, s), ids in want.items()}
    for make in (similarity.token_rows, similarity.token_sets):
        got = similarity.max_similarity(make(df, ["g"], "id", "text"), ["g"]).collect()
        assert {(r.g, r.id): (r.copies, r.max_similarity) for r in got} == {(g, min(ids)): (len(ids), pytest.approx(best[g, s], abs=1e-6)) for (g, s), ids in want.items()}
        assert len(got) == len(want)
        mean = {r.g: r.mean_max_similarity for r in similarity.mean_max_similarity(make(df, ["g"], "id", "text"), ["g"]).collect()}
        of = {g: [(len(ids), best[g, s]) for (h, s), ids in want.items() if h == g] for g, _ in want}
        assert mean == {g: pytest.approx(sum(n * v for n, v in x) / sum(n for n, _ in x), abs=1e-6) if sum(n for n, _ in x) > 1 else 0.0 for g, x in of.items()}


@pytest.mark.parametrize("block", [4, 30, 1000])
def test_best_matches_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = notes(120, ("g", None, "h", "g")) + [("one", 500, "alone here"), ("two", 501, "same words"), ("two", 502, "words same"), ("none", 503, "!"), (None, 504, None)]
    got = similarity.max_similarity(similarity.token_sets(spark.createDataFrame(rows, "g string, id int, text string"), ["g"], "id", "text"), ["g"]).collect()
    assert sorted(r.id for r in got) == [*range(120), 500, 501]
    assert {r.id: (r.copies, r.max_similarity) for r in got if r.id >= 500} == {500: (1, 0.0), 501: (2, 1.0)}
    words = {i: (g, set(t.split())) for g, i, t in rows[:120]}
    for r in got:
        if r.id < 500:
            g, s = words[r.id]
            assert (r.g, r.max_similarity) == (g, pytest.approx(max(len(s & x) / len(s | x) for i, (h, x) in words.items() if h == g and i != r.id), abs=1e-6))


@pytest.mark.parametrize(("rows", "piece", "frequent", "columns"), [(256, 1 << 20, 0.006, 1024), (7, 5, 0.006, 3), (16, 50, 2, 1024), (1, 1, 0.0, 8)])
def test_best_matches_by_matrix_and_postings(monkeypatch, rows, piece, frequent, columns):
    for k, v in (("ROWS", rows), ("PIECE", piece), ("FREQUENT", frequent), ("COLUMNS", columns)):
        monkeypatch.setattr(similarity, k, v)
    rng = random.Random(3)
    sets = list({frozenset(int(rng.expovariate(1 / 15)) * 10**15 - 3 for _ in range(rng.randint(1, 25))) for _ in range(90)})
    keys, sizes = np.array([k for x in sets for k in x]), np.array([len(x) for x in sets])
    second = np.arange(len(sets)) % 3 == 1
    for part in (None, second):
        want = [max((len(a & b) / len(a | b) for j, b in enumerate(sets) if j != i and (part is None or part[i] != part[j])), default=0.0) for i, a in enumerate(sets)]
        assert similarity.best_matches(keys, sizes, part).tolist() == want


def test_robust_statistics(spark):
    df = spark.createDataFrame([(e, "P", float(r)) for e, r in zip("abcdef", (1, 2, 4, 9, 9, 50))] + [("x", "Q", 1.0), ("y", "Q", 1.0)], "entity string, period string, rate double")
    r = {(x.entity, x.period): x for x in robust.summaries(df).collect()}
    t = r["f", "P"]
    assert (t.peers, t.baseline, t.median, t.q1, t.q3, t.mad, t.rank, t.percentile) == (5, "LIMITED", 4.0, 2.0, 9.0, 3.0, 6, 1.0)
    assert t.modified_z == pytest.approx(0.6745 * 46 / 3, abs=1e-5)
    assert (r["x", "Q"].baseline, r["x", "Q"].modified_z, r["x", "Q"].lower_fence) == ("UNAVAILABLE", None, None)


def test_cohort_tiers(spark):
    df = spark.createDataFrame([("a", "P", "s"), ("b", "P", "s"), ("c", "P", None), ("d", "Q", "s")], "entity string, period string, sector string")
    got = {r.entity: (r.tier, r.peers) for r in robust.cohort_tiers(df, [["period", "sector"], ["period"]]).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (2, 2)}


def test_features_are_null_without_evidence(spark):
    df = recs(spark, [("E", "P", "CRITICAL", "ESCALATED", "a", ""), ("E", "P", "LOW", None, "b", ""), ("F", "P", None, None, None, "")]).drop("state")
    f = {r.entity: r for r in features.scope_features(df).collect()}
    assert (f["E"].critical_share, f["E"].mean_severity, f["E"].severity_entropy, f["E"].max_group_share) == (0.5, 0.625, 0.5, 0.5)
    assert all(f["F"][c] is None for c in ("critical_share", "mean_severity", "escalation_populated", "escalated_share", "concept_coverage", "severity_entropy", "max_group_share"))


def test_forest_finds_planted_outliers(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(1000, 9.0, -9.0), (1001, None, 1.0), (1002, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    nodes = forest.train(df, ["x", "y"], ["id"], trees=40, sample=128)
    s = {r.id: r for r in forest.score(df, nodes, ["x", "y"], 0.05).collect()}
    assert s[1000].verdict == "POTENTIAL_OPERATIONAL_ANOMALY" and s[1000].score == max(r.score for r in s.values() if r.score is not None)
    assert {s[1001].verdict, s[1002].verdict} == {"NOT_EVALUABLE"}
    again = forest.train(df, ["x", "y"], ["id"], trees=40, sample=128)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    forest.save(nodes, str(tmp_path / "f"), {"features": ["x", "y"]})
    assert forest.load(spark, str(tmp_path / "f"))[1]["features"] == ["x", "y"]
    nodes.limit(3).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "f/nodes"))
    with pytest.raises(ValueError):
        forest.load(spark, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        forest.train(df.limit(2), ["x", "y"], ["id"])
    e = forest.explain(forest.score(df, nodes if False else again, ["x", "y"]), ["x", "y"], ["id"]).where("id = 1000").first()
    assert len(e.contributors) == 2 and e.contributors[0].distance > 2


def test_filters_and_profiles(spark):
    df = spark.createDataFrame([(1, "a_b", 2.0, True), (2, None, 4.0, False), (3, "a%b", None, None), (4, "a_b", 2.0, True)], "id int, s string, x double, b boolean")
    assert filters.where(df, [("s", "ne", "a_b")]).count() == 2
    assert filters.where(df, [("s", "contains", "_")]).count() == 2
    with pytest.raises(ValueError):
        filters.where(df, [("nope", "eq", 1)])
    with pytest.raises(ValueError):
        filters.where(df, [("s", "like", 1)])
    assert [r.id for r in filters.project(df, ["s"], "id", 2, 1).collect()] == [2, 3]
    inv = {r.column_name: r for r in profile.inventory(df).collect()}
    assert (inv["s"].unique_values, inv["s"].null_values, inv["x"].mean, inv["b"].mean) == (2, 1, 2.6667, 0.6667)
    empty = {r.column_name: r for r in profile.inventory(df.limit(0)).collect()}
    assert (empty["x"].total_rows, empty["x"].mean, empty["x"].std) == (0, None, None)
    assert [r.value for r in profile.appearance_samples(df, "s", "id").collect()] == ["a_b", "a%b"]
    assert {r.column_name: r.samples for r in profile.all_samples(df, ["s", "x"], "id", 1).collect()} == {"s": ["a_b"], "x": ["2.0"]}
    t = profile.top_with_truncation(df, "s", 1).first()
    assert (t["values"], t.truncated) == (["a_b"], False)
    assert profile.dataset_profile(profile.inventory(df)).first().missing_percent == 18.75


def test_relations_and_validation(spark):
    alerts = spark.createDataFrame([("A1", "HIGH"), ("A2", "odd"), ("A2", "n/a"), (" A3 ", None)], "alert_id string, severity string")
    cases = spark.createDataFrame([("C1", "A1"), ("C1", "ZZ"), ("C2", "ZZ"), ("C3", None), ("C3", "a1")], "case_id string, alert_id string").withColumns({"acknowledged_at": F.lit(None).cast("timestamp_ntz"), "closed_at": F.lit(None).cast("timestamp_ntz")})
    s = {r.fact: r.n for r in relations.summary(alerts, cases).collect()}
    assert s == {"alerts": 3, "cases": 3, "linked_cases": 1, "orphan_cases": 2, "unmatched_alerts": 2, "rows_without_alert_key": 1}
    v = {r.code: r.n for r in validation.issues(alerts, cases).collect()}
    assert v == {"DUPLICATE_ALERT_ID": 1, "DUPLICATE_CASE_ID": 2, "CONFLICTING_IDENTIFIERS": 1, "ORPHAN_CASE": 2, "UNMATCHED_ALERT": 2, "MISSING_JOIN_KEY": 1, "INVALID_SEVERITY": 1}
    c = relations.capped(alerts.select("alert_id").distinct(), "alert_id", 2).first()
    assert (c.n, c.truncated, len(c.first_values)) == (3, True, 2)


def test_scoring_and_agreement(spark):
    f = spark.createDataFrame([("e", "HIGH"), ("e", "CRITICAL"), ("g", "x")], "entity string, level string")
    s = {r.entity: r for r in scoring.weighted_score(f, ["entity"], "level", {"HIGH": 60, "CRITICAL": 60}, 5, 100, [(70, "HIGH"), (40, "MEDIUM")], "LOW").collect()}
    assert (s["e"].score, s["e"].band, s["g"].band) == (100.0, "HIGH", "LOW")
    d = spark.createDataFrame([("k", "a|b| c |", "b"), ("m", None, "x")], "k string, want string, have string")
    assert {tuple(r) for r in scoring.set_difference(d, "k", "want", "have", r"\|").collect()} == {("k", "a"), ("k", "c")}
    K = "entity string, period string, family string"
    e, h = spark.createDataFrame([("a", "1", "f"), ("b", "1", "f"), ("c", "1", "f")], K), spark.createDataFrame([("a", "1", "f"), ("b", "2", "f"), ("d", "1", "f")], K)
    got = {(r.entity, r.period): r.agreement for r in agreement.compare(e, h).collect()}
    assert got == {("a", "1"): "MATCH", ("b", "1"): "SCOPE_MISMATCH", ("b", "2"): "SCOPE_MISMATCH", ("c", "1"): "FALSE_POSITIVE", ("d", "1"): "FALSE_NEGATIVE"}
    m = agreement.metrics(e, h.limit(0)).first()
    assert (m.precision, m.recall) == (0.0, None)


def row(name, category, *samples):
    return {"column_name": name, "category": category, "samples": list(samples)}


def test_mapping_is_stable_under_renaming():
    a = mapping.decide([row("priority", "categorical", "HIGH"), row("host", "identifier", "DB-01"), row("investigation_notes", "categorical", "looked at the host again"), row("random_field", "categorical", "x")])
    b = mapping.decide([row("severity", "categorical", "HIGH"), row("asset_name", "identifier", "DB-01"), row("analyst_findings", "categorical", "looked at the host again"), row("blob", "categorical", "x")])
    assert [d.concept for d in a] == [d.concept for d in b] == ["SECURITY_SEVERITY", "ASSET_IDENTIFIER", "INVESTIGATION_EVIDENCE", None]


def test_mapping_collisions_guards_and_overrides():
    ds = mapping.decide([row("priority", "categorical", "HIGH"), row("severity", "categorical", "LOW"), row("closed_by", "categorical", "ann.a")])
    by = {d.column: d for d in ds}
    assert by["priority"].applied and not by["severity"].applied and by["severity"].state == mapping.AMBIGUOUS
    new, rejected = mapping.override(ds, {"closed_by": "RESOLUTION_TIME", "severity": "SECURITY_SEVERITY", "nope": "ALERT_ID"})
    assert set(rejected) == {"closed_by", "severity", "nope"}
    assert mapping.report(new)["columns"] == 3
    assert mapping.role(mapping.decide([row("alert_id", "identifier", "ALRT-1"), row("priority", "categorical", "HIGH")]))[0] == "ALERTS"


def test_canonical_projection(spark):
    df = spark.createDataFrame([("DB-1", "some words of a note"), (None, " ")], "host string, investigation_notes string")
    ds = mapping.decide([row("host", "identifier", "DB-1"), row("investigation_notes", "categorical", "some words of a note")])
    r = mapping.canonical(df, ds).collect()
    assert (r[0].asset_context.asset_id, r[0].investigation_context.available, r[1].investigation_context.available) == ("DB-1", True, False)


def test_texts(spark):
    from auditlake.functions import texts

    df = spark.createDataFrame([(1, "a,b  c", -7.6), (12, None, -0.1), (23, "", -4.0)], "n int, s string, p double")
    r = df.select(texts.ordinal(F.col("n")).alias("o"), texts.listed(F.col("s")).alias("l"), texts.probability_phrase(F.col("p")).alias("p"), texts.template("{n} of {s}", df.columns).alias("t")).collect()
    assert [x.o for x in r] == ["1st", "12th", "23rd"] and [x.l for x in r] == [["A", "B", "C"], None, []]
    assert [x.p for x in r] == ["about 1 in 10^7", "0.7943", "about 1 in 10^4"] and r[1].t == "12 of -"
    with pytest.raises(ValueError):
        texts.template("{nope}", df.columns)
    assert texts.fingerprint({"b": 1, "a": 2}) == texts.fingerprint({"a": 2, "b": 1})


def test_claims(spark):
    recs_ = spark.createDataFrame([("e", "p", 1, "high")], "entity string, period string, row_ordinal int, severity string")
    claims = spark.createDataFrame([("e", "p", 1, "HIGH"), ("e", "p", 1, "LOW"), ("e", "p", 2, "HIGH")], "entity string, period string, row_ordinal int, value string")
    assert agreement.unsupported_values(claims, recs_, "severity").count() == 2
    assert agreement.untraceable(claims, recs_).count() == 1
    m = spark.createDataFrame([(4, 3, 1, 0.75), (4, 3, 2, 0.75), (0, 0, 0, None)], "triggered int, with_evidence int, without_evidence int, coverage double")
    assert agreement.wrong_arithmetic(m).count() == 1
    t = agreement.review_template(recs_, ["f", "g"])
    assert t.count() == 2 and agreement.reviewer_labels(t).count() == 0
    assert agreement.reviewer_labels(t.withColumn("indicator", F.lit("X, y"))).count() == 4


def test_vocabularies_hold_the_fixed_words(spark):
    from auditlake.functions import vocabulary

    known = {"severity": {"S1": "CRITICAL", "INFO": "LOW", "sev-3": "MEDIUM", "1": None, "URGENT": None}, "escalation": {"Escalate": "ESCALATED", "requested": "PENDING", "none": None, "L2": None}, "disposition": {"deferred": "WONT_FIX", "Won't fix": "WONT_FIX", "re-opened": "OPEN", "merged": None}}
    for name, words in known.items():
        assert values(spark, list(words), lambda c, n=name: vocabulary.canonical(c, n)) == list(words.values())


def test_accepted_time_formats(spark):
    from auditlake.functions import dates

    texts = {"12-Jan-2026": "2026-01-12", "2026-01-12T10:11": "2026-01-12", "2026-01-12T01:00:00+02:00": "2026-01-11", "01.02.2026": None, "12-01-2026": None, "3/4/2026 10:11": None, "4/13/2026": "2026-04-13", "2026-02-30": None}
    assert values(spark, list(texts), lambda c: F.date_format(dates.parse(c), "yyyy-MM-dd")) == list(texts.values())
    assert values(spark, ["12-01-2026", "12-Jan-2026", "4/13/2026"], lambda c: F.date_format(dates.parse_period(c), "yyyy-MM-dd")) == ["2026-01-12", None, None]


def test_every_issue_code(spark):
    t = lambda s: f"2026-01-0{s} 00:00:00"
    alerts = spark.createDataFrame([("A1", "HIGH", t(2)), ("A2", "odd", t(3)), ("A2", "HIGH", t(3)), ("A9", "LOW", t(1))], "alert_id string, severity string, alert_ts string").withColumn("alert_ts", F.col("alert_ts").cast("timestamp"))
    cases = spark.createDataFrame([("C1", "A1", t(1), t(3)), ("C1", "a1", t(3), t(2)), ("C2", "ZZ", None, None), ("C3", None, None, None), ("C4", "A2", None, t(1)), ("C5", "A1", "soon", t(9))], "case_id string, alert_id string, acknowledged_at string, closed_at string")
    events = spark.createDataFrame([("C1",), ("C77",)], "event_case string")
    got = {(r.code, r.detail): r.n for r in validation.issues(alerts, cases, events, "event_case").collect()}
    assert {c for c, _ in got} == {"DUPLICATE_ALERT_ID", "DUPLICATE_CASE_ID", "CONFLICTING_IDENTIFIERS", "ORPHAN_CASE", "UNMATCHED_ALERT", "MISSING_JOIN_KEY", "ORPHAN_WORKFLOW_EVENT", "INVALID_SEVERITY", "INVALID_TIMESTAMP", "IMPOSSIBLE_CHRONOLOGY"}
    assert {d for c, d in got if c == "IMPOSSIBLE_CHRONOLOGY"} == {"acknowledged_at < triggered_at", "closed_at < acknowledged_at", "closed_at < triggered_at"}
    assert validation.join_issues(alerts, None).first().code == "JOIN_NOT_ASSESSABLE"
    rows = [{"column_name": n, "category": "identifier", "samples": ["ABC-1"]} for n in ("alert_id", "alert_identifier")]
    codes = {r.code for r in validation.mapping_issues(spark, "ALERTS", mapping.decide(rows)).collect()}
    assert codes == {"MAPPING_COLLISION", "MISSING_REQUIRED_FIELD"}
    r = {x.code: x for x in validation.rollup(validation.issues(alerts, cases)).collect()}
    assert r["ORPHAN_CASE"].errors == sum(x.issues for x in r.values() if x.severity == "error")


def test_absence_of_every_expected_concept(spark):
    df = spark.createDataFrame([("E", "P", 1, "CRITICAL", "ESCALATED", ""), ("E", "P", 2, "CRITICAL", "PENDING", "x"), ("E", "P", 3, "LOW", "", "")], "entity string, period string, row_ordinal long, severity string, escalation string, notes string")
    rule = rules.AbsenceRule("r", rules.Condition("severity", "in", ("CRITICAL",)), ("escalation", "notes"), {"escalation": ("ESCALATED",)})
    got = {r.concept: (r.triggered, r.with_evidence, r.without_evidence, r.unusable, r.state) for r in rules.absence_coverage(df, rule).collect()}
    assert got == {"escalation": (2, 1, 1, 1, "PARTIAL_ABSENCE"), "notes": (2, 1, 1, 0, "PARTIAL_ABSENCE")}
    assert [(r.row_ordinal, r.unusable) for r in rules.absence_positions(df, rule).collect()] == [(2, True)]


def test_signatures_and_index(spark):
    rows = [("g", i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(20)) + f" x{i % 2}") for i in range(20)]
    sets = similarity.token_sets(spark.createDataFrame(rows, "g string, id long, text string"), ["g"], "id", "text")
    exact = {(r.a, r.b) for r in similarity.similar_pairs(sets, ["g"], 0.8).collect()}
    assert exact == {(2 * k, 2 * k + 1) for k in range(10)}
    assert {(r.a, r.b) for r in similarity.indexed_pairs(sets, similarity.band_index(sets, ["g"]), ["g"], 0.8).collect()} == exact
    a, b = sets.orderBy("id").select(similarity.signature("toks").alias("s")).head(2)
    est = spark.createDataFrame([(a.s, b.s)], "a array<bigint>, b array<bigint>").select(similarity.estimated_jaccard("a", "b")).first()[0]
    assert abs(est - 20 / 22) < 0.1
    plain = {r.id: r.max_similarity for r in similarity.max_similarity(sets, ["g"]).collect()}
    assert plain == {r.id: r.max_similarity for r in similarity.max_similarity(sets, ["g"], 0.6).collect()} and len(plain) == 20
    assert similarity.mean_max_similarity(sets, ["g"]).first().mean_max_similarity == pytest.approx(20 / 22, abs=1e-6)


def test_labels_point_along_long_chains(spark):
    from auditlake.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "x long, y long")
    got = {r.id: r.component for r in graph.components(edges, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
