"""References to records that do not exist: missing, late or deleted (problem 7).

References are aggregated per table, key and period first (map-side combined): how many,
the first and the last time received. One such row meets its key's summary, whatever the
number of references, so a key that a third of all rows refer to is a handful of rows in
the join. A group is settled whole where its first and last time say so: no such key
(`missing`), all before the first load (`late`), or all inside one living spell (no
orphan). Only groups with times on both sides of a boundary look at their rows.

Rows of settled and open groups come back by a join on the group. Groups with more than
1/`parts` of all references are at most `parts` many, whatever the data: they are checked
by broadcast, so no task receives a hot key. All others are shuffled; both are united.
`parts` follows the session's shuffle partitions.

Each key's target rows are summarised once: first load time, and the spells in which
the record is alive, merged so that they do not overlap. A null load time counts as
loaded from the beginning, a null deletion time as never deleted. References without
a received time are compared as if received after everything.

Defined results: null or absent keys are no references; repeated target rows change
nothing; an empty target table makes every reference `missing`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from auditlake.columns import is_submitted_absent, strip
from auditlake.session import ensure_checkpoint_dir

BEGIN, END = "0001-01-01 00:00:00", "9999-12-31 23:59:59"
GROUP = ["table_name", "key", "period"]
LEAST_PARTS = 64


def reference_key(c: str):
    """Trimmed, case-blind key; NULL for absent spellings."""
    return F.when(~is_submitted_absent(c), F.upper(strip(c)))


def alive_spells(target: DataFrame) -> DataFrame:
    """(key, spell_from, spell_to): merged, disjoint spells in which a key has a live row."""
    t = target.select(
        reference_key("alert_id").alias("key"),
        F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit(BEGIN).cast("timestamp")).alias("a"),
        F.coalesce(F.col("deleted_at").cast("timestamp"), F.lit(END).cast("timestamp")).alias("z"),
    ).where("key IS NOT NULL")
    t = t.groupBy("key", "a").agg(F.max("z").alias("z"))
    w = Window.partitionBy("key").orderBy("a")
    t = t.withColumn("reach", F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("spell", F.sum(F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)).over(w))
    return t.groupBy("key", "spell").agg(F.min("a").alias("spell_from"), F.max("z").alias("spell_to"))


def key_summary(target: DataFrame) -> DataFrame:
    """One row per key: first load time and its alive spells."""
    s = alive_spells(target)
    return s.groupBy("key").agg(F.min("spell_from").alias("first_loaded"), F.collect_list(F.struct("spell_from", "spell_to")).alias("spells"))


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_id, period, key, received_at) of every present reference."""
    out = None
    for name, df in tables.items():
        r = df.select(F.lit(name).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), F.col("period").cast("string").alias("period"), reference_key("alert_id").alias("key"), F.coalesce(F.col("received_at").cast("timestamp"), F.lit(END).cast("timestamp")).alias("received_at")).where("key IS NOT NULL")
        out = r if out is None else out.unionByName(r)
    return out


class References:
    """References aggregated per group and judged against the target table."""

    def __init__(self, tables: dict[str, DataFrame], target: DataFrame, parts: int | None = None) -> None:
        spark = target.sparkSession
        ensure_checkpoint_dir(spark)
        self.refs = references(tables)
        self.parts = parts or max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        groups = self.refs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("received_at").alias("first"), F.max("received_at").alias("last"))
        j = groups.join(key_summary(target), "key", "left")
        whole = lambda s: (s.spell_from <= F.col("first")) & (s.spell_to > F.col("last"))
        verdict = (
            F.when(F.col("first_loaded").isNull(), "missing").when(F.col("first_loaded") > F.col("last"), "late")
            .when(F.exists("spells", whole), "held").otherwise("open")
        )
        # What is known of every group, written once; spells stay only where rows must be looked at.
        judged = j.select(*GROUP, "n", verdict.alias("verdict"), F.when(verdict == "open", F.col("first_loaded")).alias("first_loaded"), F.when(verdict == "open", F.col("spells")).alias("spells"))
        self.groups = judged.checkpoint()
        seen = Observation()
        top = self.groups.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("total")).orderBy(F.desc("n")).limit(self.parts).collect()
        total = seen.get["total"]
        self.heavy = sum(r.n * self.parts > total for r in top)
        self.least = total // self.parts  # groups above are heavy, at most `parts` of them

    def _rows(self, groups: DataFrame) -> DataFrame:
        """(table_name, row_id, period, reason | NULL) of the rows of the groups given."""
        period = F.coalesce("period", F.lit("\0")).alias("_p")  # a null period is a group of its own
        on = ["table_name", "key", "_p"]
        r = self.refs.select("*", period)
        side = lambda df: df.select("table_name", "key", period, "verdict", "first_loaded", "spells")
        if not self.heavy:
            both = r.join(side(groups), on)
        else:
            is_heavy = F.col("n") > self.least
            hot = r.join(F.broadcast(side(groups.where(is_heavy))), on)  # at most `parts` rows
            heavy = self.groups.where(is_heavy).select("table_name", "key", period)
            cold = r.join(F.broadcast(heavy), on, "left_anti").join(side(groups.where(~is_heavy)), on)
            both = hot.unionByName(cold)
        at = F.col("received_at")
        alive = F.exists("spells", lambda s: (s.spell_from <= at) & (s.spell_to > at))
        reason = F.when(F.col("verdict") != "open", F.col("verdict")).when(F.col("first_loaded") > at, "late").when(~alive, "deleted")
        return both.select("table_name", "row_id", "period", reason.alias("reason")).where("reason IS NOT NULL")

    def orphans(self) -> DataFrame:
        """(table_name, row_id, period, reason) of every reference that does not hold."""
        return self._rows(self.groups.where("verdict <> 'held'"))

    def report(self) -> DataFrame:
        """Orphan counts per table, period and reason with the references checked there; only open groups are read as rows."""
        known = self.groups.where("verdict IN ('missing', 'late')").select("table_name", "period", F.col("verdict").alias("reason"), "n")
        rows = self._rows(self.groups.where("verdict = 'open'")).select("table_name", "period", "reason", F.lit(1).cast("bigint").alias("n"))
        bad = known.unionByName(rows).groupBy("table_name", "period", "reason").agg(F.sum("n").alias("orphans"))
        checked = self.groups.groupBy("table_name", "period").agg(F.sum("n").alias("refs"))
        on = (F.col("b.table_name") == F.col("r.table_name")) & F.col("b.period").eqNullSafe(F.col("r.period"))
        return bad.alias("b").join(checked.alias("r"), on).select("b.table_name", "b.period", "reason", "orphans", F.col("refs").alias("checked_references"))


def orphans(tables: dict[str, DataFrame], target: DataFrame, parts: int | None = None) -> DataFrame:
    """(table_name, row_id, period, reason) of every reference that does not hold."""
    return References(tables, target, parts).orphans()


def orphan_report(tables: dict[str, DataFrame], target: DataFrame, parts: int | None = None) -> DataFrame:
    """Orphan counts per table, period and reason, with the references checked there."""
    return References(tables, target, parts).report()
