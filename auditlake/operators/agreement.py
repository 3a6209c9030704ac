"""Agreement between engine findings and reviewer labels on (scope, family)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.columns import norm_value

KEYS = ["entity", "period", "family"]
TOLERANCE = 1e-4  # fixed value: how far a stated coverage may be off


def compare(engine: DataFrame, reviewer: DataFrame) -> DataFrame:
    """One row per (scope, family): MATCH, MATCH_UNSUPPORTED, SCOPE_MISMATCH, FALSE_POSITIVE or FALSE_NEGATIVE.

    A difference is a scope mismatch where both sides name the family for the entity, in
    other periods. Where the engine's rows carry `supported`, a match none of whose rows is
    supported by its cited evidence is MATCH_UNSUPPORTED.
    """
    supported = F.col("supported") if "supported" in engine.columns else F.lit(True)
    e, r = engine.select(*KEYS, supported.alias("s")).groupBy(*KEYS).agg(F.max("s").alias("s")).withColumn("e", F.lit(True)), reviewer.select(*KEYS).distinct().withColumn("r", F.lit(True))
    j = e.join(r, KEYS, "full_outer")
    side = lambda df, n: df.select("entity", "family").distinct().withColumn(n, F.lit(True))
    j = j.join(side(e, "e_any"), ["entity", "family"], "left").join(side(r, "r_any"), ["entity", "family"], "left")
    state = (
        F.when(F.col("e") & F.col("r"), F.when(F.col("s"), "MATCH").otherwise("MATCH_UNSUPPORTED"))
        .when(F.col("e") & F.col("r_any"), "SCOPE_MISMATCH")
        .when(F.col("r") & F.col("e_any"), "SCOPE_MISMATCH")
        .when(F.col("e"), "FALSE_POSITIVE")
        .otherwise("FALSE_NEGATIVE")
    )
    return j.select(*KEYS, state.alias("agreement"))


def metrics(engine: DataFrame, reviewer: DataFrame) -> DataFrame:
    """Precision and recall per family, NULL where there is nothing to divide by."""
    e, r = engine.select(*KEYS).distinct().withColumn("e", F.lit(1)), reviewer.select(*KEYS).distinct().withColumn("r", F.lit(1))
    g = e.join(r, KEYS, "full_outer").groupBy("family").agg(F.count_if(F.col("e").isNotNull() & F.col("r").isNotNull()).alias("matches"), F.count("e").alias("engine"), F.count("r").alias("reviewer"))
    return g.select("family", "matches", "engine", "reviewer", F.when(F.col("engine") > 0, F.round(F.col("matches") / F.col("engine"), 4)).alias("precision"), F.when(F.col("reviewer") > 0, F.round(F.col("matches") / F.col("reviewer"), 4)).alias("recall"))


def untraceable(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings whose cited row is not a record of their scope."""
    return findings.join(records.select("entity", "period", "row_ordinal"), ["entity", "period", "row_ordinal"], "left_anti")


def wrong_arithmetic(measures: DataFrame) -> DataFrame:
    """Absence measures whose own figures do not add up: parts and whole, coverage within `TOLERANCE`, witnesses where stated."""
    share = F.col("with_evidence") / F.col("triggered")
    covered = F.when(F.col("triggered") > 0, F.coalesce(F.abs(F.col("coverage") - share) <= TOLERANCE, F.lit(False))).otherwise(F.col("coverage").isNull())
    ok = (F.col("with_evidence") + F.col("without_evidence") == F.col("triggered")) & covered
    if "witnesses" in measures.columns:
        ok = ok & (F.col("witnesses") == F.col("without_evidence"))
    return measures.where(~ok)


def operational(claims: DataFrame, cited: DataFrame, records: DataFrame, concept: str) -> DataFrame:
    """Checks of claims (entity, period, group_value, group_count, scope_count) against the records they cite.

    `cited` is (entity, period, row_ordinal), one row per cited record. Adds what is there
    (`found_cited`, `found_sharing`, `found_scope`) and whether the cited records carry the
    named value, the counts agree, and the population is that of the scope.
    """
    scope = ["entity", "period"]
    size = records.groupBy(*scope).agg(F.count("*").alias("found_scope"))
    r = records.select(*scope, "row_ordinal", norm_value(concept).alias("have"))
    j = cited.join(claims.select(*scope, norm_value("group_value").alias("want")), scope).join(r, [*scope, "row_ordinal"], "left")
    seen = j.groupBy(*scope).agg(F.count("*").alias("found_cited"), F.count_if(F.col("have") == F.col("want")).alias("found_sharing"))
    out = claims.join(seen, scope, "left").join(size, scope, "left").na.fill(0, ["found_cited", "found_sharing", "found_scope"])
    return out.withColumns({"shares_value": (F.col("found_cited") > 0) & (F.col("found_sharing") == F.col("found_cited")), "count_matches": F.col("group_count") == F.col("found_cited"), "population_matches": F.col("scope_count") == F.col("found_scope")})


def collisions(decisions: DataFrame) -> DataFrame:
    """(concept, columns): concepts that several columns supply, from (column, concept) rows."""
    return decisions.where("concept IS NOT NULL").groupBy("concept").agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"), F.countDistinct("column").alias("n")).where("n > 1").drop("n")


def declined(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per scope the patterns (entity, period, pattern) declined and expected to be, and whether they agree; NULL where nothing was expected."""
    scope = ["entity", "period"]
    a = actual.select(*scope, "pattern").distinct().withColumn("a", F.lit(1))
    j = a.join(expected.select(*scope, "pattern").distinct().withColumn("x", F.lit(1)), [*scope, "pattern"], "full_outer")
    g = j.groupBy(*scope).agg(F.count("a").alias("declined"), F.count("x").alias("expected"), F.count_if(F.col("a").isNull() | F.col("x").isNull()).alias("apart"))
    return g.select(*scope, "declined", "expected", F.when(F.col("expected") > 0, F.col("apart") == 0).alias("agrees"))


def scope_rows(records: DataFrame, entity: str, period: str) -> DataFrame:
    """Rows of one scope."""
    return records.where((F.col("entity") == entity) & (F.col("period") == period)).select("row_ordinal")


def concept_sources(decisions: DataFrame, columns: list[str], wanted: list[str]) -> DataFrame:
    """(concept, column, declared): applied source columns of the wanted concepts, else a column of the same name."""
    w = decisions.sparkSession.createDataFrame([(c,) for c in wanted], "concept string")
    named = decisions.sparkSession.createDataFrame([(c.upper(), c) for c in columns] or [("", None)], "concept string, by_name string")
    j = w.join(decisions.where("applied").select("concept", "column"), "concept", "left").join(named, "concept", "left")
    return j.select("concept", F.coalesce("column", "by_name").alias("column"), F.col("column").isNotNull().alias("declared"))


def unsupported_values(claims: DataFrame, records: DataFrame, concept: str) -> DataFrame:
    """Claims (entity, period, row_ordinal, value) whose cited row does not carry the value."""
    r = records.select("entity", "period", "row_ordinal", norm_value(concept).alias("have"))
    j = claims.join(r, ["entity", "period", "row_ordinal"], "left")
    return j.where(~norm_value("value").eqNullSafe(F.col("have"))).drop("have")


def review_template(cases: DataFrame, families: list[str]) -> DataFrame:
    """One blank line per (scope, family) for a reviewer to fill."""
    return cases.select("entity", "period", F.explode(F.array(*map(F.lit, families))).alias("family"), F.lit(None).cast("string").alias("indicator"), F.lit(None).cast("string").alias("note"))


def reviewer_labels(filled: DataFrame) -> DataFrame:
    """Filled template as labels; a list of indicators gives one label each."""
    from auditlake.functions.texts import listed

    return filled.where("indicator IS NOT NULL").select("entity", "period", "family", F.explode(listed(F.col("indicator"))).alias("indicator"))
