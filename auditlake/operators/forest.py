"""Isolation forest over scope features: trees grown in parallel groups, scores by Arrow batches.

The training matrix is a bounded sample per tree (`sample` rows), drawn by a seeded
hash so that any run grows the same trees. Trees are kept as a table of nodes, written
as parquet with a metadata file and digest; no pickles. Scores follow Liu, Ting and Zhou
(2008): s = 2^(-E[path] / c(sample)); the decision offset is the contamination quantile,
taken from mergeable quantile summaries. `df` is read several times by train and score:
store it first.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.session import ship_package

ACCURACY = 100_000  # rank error of the quantiles: below 1/100,000 of the rows, none on tables smaller than that
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int"


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """Nodes of one isolation tree over the rows of x."""
    rng = np.random.default_rng(seed * 100_003 + tree)
    limit = math.ceil(math.log2(max(2, len(x))))
    rows: list[tuple] = []

    def build(idx: np.ndarray, depth: int) -> int:
        at = len(rows)
        rows.append((tree, at, -1, 0.0, -1, -1, len(idx)))
        if depth >= limit or len(idx) <= 1:
            return at
        lo, hi = x[idx].min(0), x[idx].max(0)
        wide = np.flatnonzero(hi > lo)
        if not len(wide):
            return at
        f = int(rng.choice(wide))
        t = float(rng.uniform(lo[f], hi[f]))
        goes = x[idx, f] < t
        left, right = build(idx[goes], depth + 1), build(idx[~goes], depth + 1)
        rows[at] = (tree, at, f, t, left, right, len(idx))
        return at

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])


def check_config(config: dict, columns: list[str]) -> list[str]:
    """What is wrong with a model configuration: features unknown, repeated or missing, contamination outside (0, 0.5], too few trees or samples."""
    wrong = []
    names = config.get("features") or []
    wrong += ["no features"] if not names else []
    wrong += [f"unknown feature {n}" for n in names if n not in columns]
    wrong += [f"repeated feature {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    c = config.get("contamination", 0.1)
    if isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 < c <= 0.5:
        wrong.append("contamination must be a number in (0, 0.5]")
    wrong += [f"{k} must be a whole number of at least {n}" for k, n in (("trees", 1), ("sample", 2)) if not isinstance(config.get(k, n), int) or config.get(k, n) < n]
    return wrong


def train(df: DataFrame, features: list[str], key: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Node table of a forest; rows with a missing or non-finite feature do not train."""
    ship_package(df.sparkSession)
    ok = df
    for f in features:
        ok = ok.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    # A row enters a tree with about twice the chance that fills the sample; the exact sample
    # is the smallest hashes of what arrived, so a tree's group is bounded.
    n = ok.count()
    if n < 8:
        raise ValueError("too few complete scopes to train on")
    share = min(1.0, 2.0 * sample / n)
    draws = ok.select(*key, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("tree", F.explode(_trees_of(key, trees, share, seed)))
    draws = draws.withColumn("h", F.xxhash64(*key, "tree", F.lit(seed)))
    picked = draws.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", *key))).where(F.col("r") <= sample)
    return picked.groupBy("tree").applyInPandas(lambda g: grow(g.sort_values("r")[features].to_numpy(float), int(g["tree"].iloc[0]), seed), NODES)


def _trees_of(key: list[str], trees: int, share: float, seed: int) -> Column:
    """Array of the trees a row is drawn for: all of them, or as many draws as it has in expectation.

    A large table draws about `trees * share` < 1 trees per row from a single hash, so a row
    is not repeated for trees it never enters.
    """
    if share >= 1.0:
        return F.sequence(F.lit(0), F.lit(trees - 1))
    mean = trees * share
    unit = lambda i: F.pmod(F.xxhash64(*key, F.lit(seed), i), F.lit(1 << 40)) / float(1 << 40)
    one = lambda i: F.floor(unit(i) / F.least(F.lit(1.0), F.lit(mean) - i) * trees).cast("int")  # noqa: E731  uniform below the chance of draw i
    picks = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(mean) - 1)), lambda i: F.when(unit(i) < F.lit(mean) - i, one(i)))
    return F.array_distinct(F.array_compact(picks))


def depth_of(x: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Adjusted path length of every row in one tree."""
    f, t, left, right, size = (nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size"))
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    active = f[at] >= 0
    while active.any():
        a = at[active]
        goes = x[active, f[a]] < t[a]
        at[active] = np.where(goes, left[a], right[a])
        depth[active] += 1
        active = f[at] >= 0
    return depth + np.array([path_norm(s) for s in size])[at]


def score(df: DataFrame, nodes: DataFrame, features: list[str], contamination: float = 0.1) -> DataFrame:
    """Adds score (higher: more isolated) and verdict; incomplete rows are NOT_EVALUABLE."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    spark = df.sparkSession
    table = nodes.toPandas().sort_values(["tree", "node"])  # trees x 2 x sample rows at most, whatever the data
    forest = [g for _, g in table.groupby("tree")]
    norm = path_norm(max(int(g["size"].max()) for g in forest))
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def isolation(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for c in cols:
            x = c.to_numpy(float)
            bad = ~np.isfinite(x).all(1)
            s = 2.0 ** (-np.mean([depth_of(np.nan_to_num(x), g) for g in shared.value], axis=0) / norm)
            yield pd.Series(np.where(bad, np.nan, s))

    s = df.withColumn("score", isolation(F.struct(*[F.col(f).cast("double") for f in features]))).withColumn("score", F.when(~F.isnan("score"), F.round("score", 9)))
    cut = s.agg(F.percentile_approx("score", 1 - contamination, ACCURACY).alias("cut")).first()["cut"]
    verdict = F.when(F.col("score").isNull(), "NOT_EVALUABLE").when(F.col("score") > F.lit(cut), "POTENTIAL_OPERATIONAL_ANOMALY").otherwise("WITHIN_REFERENCE")
    return s.withColumn("verdict", verdict)


def explain(scored: DataFrame, features: list[str], key: list[str], top: int = 3) -> DataFrame:
    """Per row the `top` features by robust distance (10-90 span) from the population median."""
    qs = scored.agg(*[F.percentile_approx(F.col(f).cast("double"), [0.1, 0.5, 0.9], ACCURACY).alias(f) for f in features]).first()
    d = [F.struct((F.abs(F.col(f) - qs[f][1]) / (qs[f][2] - qs[f][0]) if qs[f] and qs[f][2] > qs[f][0] else F.lit(0.0)).alias("distance"), F.lit(f).alias("feature")) for f in features]
    return scored.select(*key, "verdict", F.slice(F.sort_array(F.array(*d), asc=False), 1, top).alias("contributors"))


def save(nodes: DataFrame, path: str, metadata: dict) -> str:
    """Write nodes as parquet and metadata with the nodes' digest; returns the digest."""
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    d = digest(nodes.sparkSession.read.parquet(f"{path}/nodes"))
    text = json.dumps({**metadata, "sha256": d}, sort_keys=True)
    nodes.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return d


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Nodes and metadata; refuses a forest whose digest does not match."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes")
    if digest(nodes) != meta["sha256"]:
        raise ValueError("the forest was changed after it was saved")
    return nodes, meta


def digest(nodes: DataFrame) -> str:
    rows = sorted(map(tuple, nodes.collect()))
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()
