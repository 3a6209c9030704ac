"""Robust comparison of each target with its peers: quartiles, MAD, modified z, rank, percentile, fences.

Peers are the other members of a cohort, so every target has a distribution of its own that
lacks one value. No pairs are formed: members are ranked once per cohort, and leaving out
the value at rank t only shifts the ranks from t on by one, so each order statistic of a
target is a lookup by (cohort, rank). Leaving out one value moves a cohort's median among
at most three values, so deviations are ranked once per cohort and median. The work is that
of sorting; a cohort is one sorted run, which spills.

An entity stands once in a cohort. Targets without a rate are compared with all members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import ensure_checkpoint_dir

NUDGE = 1e-9  # lifts interpolated values off exact rounding ties, the same on both sides of a comparison


def r6(c: Column) -> Column:
    return F.round(c + NUDGE, 6)


def summaries(metrics: DataFrame, on: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per target with all robust statistics; `baseline` says how far they carry: below 3 peers not at all, below 8 to a limited degree.

    `keys` names what identifies a target beside the columns of its cohort `on`.
    """
    keys, on = keys or ["entity", "period"], on or ["period"]
    metrics = _stored(metrics)
    cohort = F.to_json(F.array(*[F.col(c).cast("string") for c in on])).alias("cohort")
    known = metrics
    for c in on:
        known = known.where(F.col(c).isNotNull())
    return _summarise(known.select(*keys, "rate", cohort), known.where("rate IS NOT NULL").select("entity", F.col("rate").alias("v"), cohort), keys)


def tier_summaries(metrics: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """As `summaries`, each target against the peers of its own cohort: the first tier in which it has any. Adds `tier`."""
    metrics = _stored(metrics)
    chosen = cohort_tiers(metrics, tiers).select("entity", "period", "tier")
    keys = [F.when(reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in attrs]), F.struct(F.lit(i).cast("bigint").alias("tier"), F.to_json(F.array(*[F.col(a).cast("string") for a in attrs])).alias("cohort"))) for i, attrs in enumerate(tiers, 1)]
    # Every member stands in its cohort of each tier; a target looks only into that of its own tier.
    members = metrics.where("rate IS NOT NULL").select(F.col("entity").alias("peer"), F.col("rate").alias("peer_rate"), F.explode(F.array_compact(F.array(*keys))).alias("c")).select("peer", "peer_rate", "c.*")
    targets = metrics.join(chosen, ["entity", "period"]).select("entity", "period", "rate", "tier", F.element_at(F.array(*keys), F.col("tier").cast("int"))["cohort"].alias("cohort"))
    own = F.concat_ws(":", "tier", "cohort").alias("cohort")
    s = _summarise(targets.select("entity", "period", "rate", own), members.select(F.col("peer").alias("entity"), F.col("peer_rate").alias("v"), own), ["entity", "period"])
    return s.join(chosen, ["entity", "period"])


def concept_evidence(index: DataFrame, declared: list[str]) -> DataFrame:
    """(entity, period, evidenced, unresolved): declared concepts a scope has evidence of, and those it has not."""
    have = index.groupBy("entity", "period").agg(F.collect_set("concept").alias("have"))
    want = F.array(*map(F.lit, declared))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return have.select("entity", "period", listed(F.array_intersect(want, "have")).alias("evidenced"), listed(F.array_except(want, F.col("have"))).alias("unresolved"))


def with_attributes(metrics: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Metrics with the stated attributes of their entity; attributes are configuration, never inferred."""
    return metrics.join(attributes.select("entity", *names), "entity", "left")


def _stored(metrics: DataFrame) -> DataFrame:
    """One row per target, read by every step below."""
    ensure_checkpoint_dir(metrics.sparkSession)
    return metrics.checkpoint()


def _lookup(targets: DataFrame, ranked: DataFrame, on: list[str], keys: list[str], places: dict[str, Column]) -> DataFrame:
    """(keys..., one column per place): the ranked values at each target's places, its own left out.

    `targets` has `t`, the rank of its own value (NULL: none of them is its own).
    """
    shifted = lambda k: k + F.coalesce((k >= F.col("t")).cast("bigint"), F.lit(0))
    cells = F.array(*[F.struct(F.lit(n).alias("place"), shifted(F.floor(k)).alias("r")) for n, k in places.items()])
    want = targets.select(*keys, *on, F.explode(cells).alias("x")).select(*keys, *on, "x.place", "x.r")
    return want.join(ranked, [*on, "r"]).groupBy(*keys).agg(*[F.max(F.when(F.col("place") == n, F.col("v"))).alias(n) for n in places])


def _between(lo: str, hi: str, at: Column) -> Column:
    """Linear interpolation between two neighbouring order statistics."""
    part = at - F.floor(at)
    return (1 - part) * F.col(lo) + part * F.col(hi)


def _summarise(targets: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy("cohort").orderBy("v", "entity")
    m = members.select("cohort", "entity", "v", (F.row_number().over(by) - 1).cast("bigint").alias("r"), (F.rank().over(Window.partitionBy("cohort").orderBy("v")) - 1).cast("bigint").alias("below"))
    size = members.groupBy("cohort").agg(F.count("*").alias("n"))
    ties = members.groupBy("cohort", "v").agg(F.count("*").alias("ties"))
    own = m.join(ties, ["cohort", "v"]).select("cohort", "entity", F.col("r").alias("t"), "below", (F.col("ties") - 1).alias("equal"))
    t = targets.join(size, "cohort").join(own, ["cohort", "entity"], "left")
    t = t.withColumn("peers", F.col("n") - F.col("t").isNotNull().cast("bigint")).where("peers > 0").na.fill(0, ["below", "equal"])
    at = {f: (F.col("peers") - 1) * f for f in (0.25, 0.5, 0.75)}
    places = {"lo": F.lit(0).cast("double"), "hi": (F.col("peers") - 1).cast("double"), **{f"a{i}": a for i, a in enumerate(at.values())}, **{f"b{i}": F.ceil(a).cast("double") for i, a in enumerate(at.values())}}
    g = t.join(_lookup(t, m.select("cohort", "r", "v"), ["cohort"], keys, places), keys)
    g = g.withColumns({name: r6(_between(f"a{i}", f"b{i}", a)) for i, (name, a) in enumerate(zip(("q1", "median", "q3"), at.values()))}).select(*keys, "cohort", "rate", "peers", "below", "equal", "lo", "hi", "q1", "median", "q3").checkpoint()
    spread = members.join(g.select("cohort", "median").distinct(), "cohort").select("cohort", "median", "entity", F.abs(F.col("v") - F.col("median")).alias("v"))
    d = spread.withColumn("r", (F.row_number().over(Window.partitionBy("cohort", "median").orderBy("v", "entity")) - 1).cast("bigint"))
    td = g.select(*keys, "cohort", "median", "peers").join(d.select("cohort", "median", "entity", F.col("r").alias("t")), ["cohort", "median", "entity"], "left")
    half = (F.col("peers") - 1) * 0.5
    dev = _lookup(td, d.select("cohort", "median", "r", "v"), ["cohort", "median"], keys, {"a": half, "b": F.ceil(half).cast("double")}).join(td.select(*keys, "peers"), keys).select(*keys, r6(_between("a", "b", half)).alias("mad"))
    s = g.join(dev, keys)
    z = F.when(F.col("mad") > 0, r6(F.lit(0.6745) * (F.col("rate") - F.col("median")) / F.col("mad")))
    fence = lambda sign, q: F.when(F.col("peers") >= 4, r6(F.col(q) + sign * 1.5 * (F.col("q3") - F.col("q1"))))
    return s.select(
        *keys, "rate", "peers", F.when(F.col("peers") < 3, "UNAVAILABLE").when(F.col("peers") < 8, "LIMITED").otherwise("ROBUST").alias("baseline"),
        "lo", "q1", "median", "q3", "hi", "mad", z.alias("modified_z"), (F.col("below") + 1).alias("rank"),
        F.when(F.col("rate").isNotNull(), r6((F.col("below") + 0.5 * F.col("equal")) / F.col("peers"))).alias("percentile"), fence(-1, "q1").alias("lower_fence"), fence(1, "q3").alias("upper_fence"),
        F.when(F.abs(z) > 3.5, "STRONG").when(F.abs(z) > 1.5, "MODERATE").when(z.isNotNull(), "TYPICAL").alias("band"),
    )


def cohort_tiers(scopes: DataFrame, tiers: list[list[str]], key: str = "entity") -> DataFrame:
    """(entity, period, tier, peers): the first tier in which a target has peers, and how many.

    Each tier is a list of columns that must be present and equal; a tier whose attribute
    the target lacks is skipped. Members are counted per cohort, so no pairs are formed.
    """
    out = None
    for i, attrs in enumerate(tiers):
        ok = scopes
        for a in attrs:
            ok = ok.where(F.col(a).isNotNull())
        size = ok.groupBy(*attrs).agg(F.countDistinct(key).alias("m"))
        t = ok.join(size, attrs).select(key, "period", F.lit(i + 1).cast("bigint").alias("tier"), (F.col("m") - 1).alias("peers")).where("peers > 0")
        out = t if out is None else out.unionByName(t)
    best = out.groupBy(key, "period").agg(F.min(F.struct("tier", "peers")).alias("b"))
    return best.select(key, "period", "b.tier", "b.peers")


def distribution(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, min, p10, median, p90, max, mean, population deviation, and robust span."""
    p = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    d = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(column).alias("lo"), p.alias("p"), F.max(column).alias("hi"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return d.select(*by, "n", "lo", r6(F.col("p")[0]).alias("p10"), r6(F.col("p")[1]).alias("median"), r6(F.col("p")[2]).alias("p90"), "hi", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


def robust_distance(value: Column, median: Column, p10: Column, p90: Column) -> Column:
    """Distance from the median in units of the 10-90 span; 0 when the span is empty."""
    return F.when(p90 > p10, F.abs(value - median) / (p90 - p10)).otherwise(F.lit(0.0))
