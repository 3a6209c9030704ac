"""Record layer over the star-schema tables and the record tables: one canonical frame for every layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import dates
from auditlake.session import table

SEVERITIES = {"1": "CRITICAL", "2": "HIGH", "3": "MEDIUM", "5": "LOW"}  # fixed values: priority class to severity
STATUSES = {"F": "ESCALATED", "O": "NOT_ESCALATED", "P": "PENDING"}  # fixed values: order status to escalation


def _case(c, pairs: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as alerts: one row per order with severity, escalation, entity, sector, period, asset.

    Nation and region are fixed tables of 25 and 5 rows; customers join on their key.
    """
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    place = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(place), c.c_nationkey == F.col("n_nationkey"))
    return j.select(
        F.col("o_orderkey").alias("row_ordinal"),
        _case(F.substring("o_orderpriority", 1, 1), SEVERITIES).alias("severity"),
        _case(F.col("o_orderstatus"), STATUSES).alias("escalation"),
        F.col("n_name").alias("entity"), F.col("r_name").alias("sector"), dates.bucket("o_orderdate", "quarter").alias("period"),
        F.col("c_custkey").alias("asset"), F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").alias("triggered_at"), F.col("o_totalprice").alias("amount"),
    )


RECORDS_SQL = """rec AS (
 SELECT o_orderkey AS row_ordinal,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '5' THEN 'LOW' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'ESCALATED' WHEN 'O' THEN 'NOT_ESCALATED' WHEN 'P' THEN 'PENDING' END AS escalation,
  n_name AS entity, r_name AS sector, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS period,
  c_custkey AS asset, c_mktsegment AS segment, o_orderdate AS triggered_at, o_totalprice AS amount
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
