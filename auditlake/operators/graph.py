"""Connected components of an edge table by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable from every id that has an edge.

    Each round an id takes the smallest label among its neighbours, then the label of that
    label, so the rounds grow with the logarithm of a component's diameter and not with
    the diameter. State is cut by checkpoint() every round; nothing is collected. A hub's
    edges are reduced on the map side before they meet its row. Ids may be of any sortable
    type; edges with a null end and loops are left out; no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    state = e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")).checkpoint()
    while True:
        near = e.join(state.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = state.join(near, "id").select("id", "component", F.least("component", "c").alias("new"))
        jump = state.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        nxt = step.join(jump, "new", "left").select("id", F.col("component").alias("old"), F.least("new", F.coalesce("jump", F.col("new"))).alias("component")).checkpoint()
        state = nxt.select("id", "component")
        if nxt.where("old <> component").isEmpty():
            return state
