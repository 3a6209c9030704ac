"""Column quality per load: null rates, distinct counts, mask patterns and changes between loads (problem 2).

Values are generalised to character-class masks (`A` capital, `a` small letter, `9`
digit, everything else itself) and, with runs written once, to patterns. The dominant pattern of a column is mined from the masks
of all its values; a caller may state a column's form instead, as a pattern of masks, as
a list of values, or both. Values outside the form are violations, masks below a share
of a load are rare, and two successive loads are compared by null rates, distinct
counts, value shares, share of violations and the divergence of their mask
distributions.

Texts are never shuffled. Values are counted under a 64-bit hash per (feed, load, column)
with map-side combination, so a value that fills a third of the table travels once per
task, and masks likewise (long ones hashed); null counts and ranges are partial
aggregates over the rows. Everything after works on one row per load and column. The
chance that two values of a load of a million share a hash is below 1e-7.

Defined results: null feed or load rows form no load and are left out; an empty
table gives no rows; extra columns are ignored; a load whose predecessor has no
rows yields no change.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import is_submitted_absent
from auditlake.session import ensure_checkpoint_dir

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def mask(c: Column) -> Column:
    """Character-class mask of a value: one class per character."""
    return F.translate(c, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "9" * 10)


def pattern(c: Column) -> Column:
    """Collapsed mask of a value: runs of one class written once."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")


NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*\z"


def number_of(c: Column) -> Column:
    """The number a text is, NULL for other texts, which are told apart before anything is cast."""
    return F.when(c.rlike(NUMBER), c.try_cast("decimal(38,10)"))


@dataclass(frozen=True)
class Form:
    """The stated form of a column: masks by a regular expression that must match as a whole, or the values allowed."""

    masks: str | None = None
    values: tuple[str, ...] = ()

    def holds(self, value: Column, m: Column) -> Column:
        ok = F.lit(True) if self.masks is None else m.rlike(f"^(?:{self.masks})\\z")
        return ok & value.isin(list(self.values)) if self.values else ok


Forms = dict[str, Form]


KEYS = ["feed_id", "load_no", "place"]  # a column travels as its position
LONG = 64
BROADCAST_VALUES = 200_000


def _load_rows(df: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Rows of a load, with its keys as numbers."""
    feed, load = (F.col(k) for k in keys)
    own = [c for c in df.columns if c not in ("_feed", "_load")]
    return df.where(feed.isNotNull() & load.isNotNull()).select(feed.cast("bigint").alias("_feed"), load.cast("bigint").alias("_load"), *own)


def _value(c: str) -> Column:
    """A column's value as written; NULL for absent spellings."""
    return F.when(~is_submitted_absent(c), F.col(c).cast("string"))


def _side(df: DataFrame) -> DataFrame:
    """A stored frame for the small side of a join: broadcast while it has at most `BROADCAST_VALUES` narrow rows."""
    return F.broadcast(df) if df.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else df


class Loads:
    """Columns of a table by feed and load: masks, values and profile, each counted once."""

    def __init__(self, df: DataFrame, columns: list[str], forms: Forms | None = None, keys: tuple[str, str] = ("feed_id", "load_no")) -> None:
        ensure_checkpoint_dir(df.sparkSession)
        self.rows, self.columns, self.forms = _load_rows(df, keys), columns, forms or {}
        self.cells = self.rows.select(F.col("_feed").alias("feed_id"), F.col("_load").alias("load_no"), F.explode(F.array(*[F.struct(F.lit(i).alias("place"), _value(c).alias("value")) for i, c in enumerate(columns)])).alias("c")).select("feed_id", "load_no", "c.*")

    def named(self, df: DataFrame) -> DataFrame:
        """Positions as column names."""
        name = F.element_at(F.array(*map(F.lit, self.columns)), F.col("place") + 1).alias("column_name")
        return df.select("feed_id", "load_no", name, *[c for c in df.columns if c not in KEYS])

    @cached_property
    def masks(self) -> DataFrame:
        """(feed, load, column, pattern, ok, n): rows per collapsed mask and verdict; NULL pattern for absent values.

        Masks longer than `LONG` are hashed. `ok` is that of the stated form, else whether
        the pattern is the column's mined one.
        """
        v = F.col("value")
        p = pattern(v)
        stated = F.lit(None).cast("boolean")
        for name, form in self.forms.items():
            if name not in self.columns:
                continue
            stated = F.when((F.col("place") == self.columns.index(name)) & v.isNotNull(), form.holds(v, mask(v))).otherwise(stated)
        short = F.when(F.length(p) <= LONG, p).otherwise(F.concat(F.lit("#"), F.substring(F.md5(p), 1, 16)))
        counted = self.cells.groupBy(*KEYS, short.alias("pattern"), stated.alias("ok")).agg(F.count("*").alias("n")).checkpoint()
        if not set(self.columns) - set(self.forms):
            return counted
        j = counted.join(F.broadcast(mined_forms(counted)), "place", "left")  # one row per column of the table
        return j.withColumn("ok", F.coalesce("ok", F.col("pattern") == F.col("form"))).select(*counted.columns)

    @cached_property
    def profile(self) -> DataFrame:
        """One row per (feed, load, column): rows, present and distinct values, values out of form, and the heavy values.

        `heavy` holds (id, n) of the values with 25 % or more of the load's present ones, at
        most four. Values are shuffled once, under their hash.
        """
        present = F.col("pattern").isNotNull()
        a = self.masks.groupBy(*KEYS).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n_present"), F.coalesce(F.sum(F.when(present & ~F.col("ok"), F.col("n"))), F.lit(0)).alias("n_off_form")).checkpoint()
        values = self.cells.where("value IS NOT NULL").groupBy(*KEYS, F.xxhash64("value").alias("id")).agg(F.count("*").alias("n"))
        d = values.groupBy(*KEYS).agg(F.count_if(F.col("n") > 0).alias("n_distinct"))  # reads n so that both uses share one shuffle
        top = values.join(_side(a.select(*KEYS, "n_present")), KEYS).where("4 * n >= n_present").groupBy(*KEYS).agg(F.collect_list(F.struct("id", "n")).alias("heavy"))  # at most four
        return a.join(d, KEYS, "left").join(top, KEYS, "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))).checkpoint()

    def ranges(self) -> DataFrame:
        """(feed, load, column, min_value, max_value): numeric where every present value of the load is a number, else of text; texts whole."""
        aggs, cells = [], []
        for i, c in enumerate(self.columns):
            v = _value(c)
            number = number_of(v)
            aggs += [F.count(v).alias(f"p{i}"), F.count(number).alias(f"k{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"), F.min_by(v, number).alias(f"x{i}"), F.max_by(v, number).alias(f"y{i}")]
            numeric = F.col(f"k{i}") == F.col(f"p{i}")
            cells.append(F.struct(F.lit(i).alias("place"), F.when(numeric, F.col(f"x{i}")).otherwise(F.col(f"a{i}")).alias("min_value"), F.when(numeric, F.col(f"y{i}")).otherwise(F.col(f"z{i}")).alias("max_value")))
        wide = self.rows.groupBy(F.col("_feed").alias("feed_id"), F.col("_load").alias("load_no")).agg(*aggs)
        return wide.select("feed_id", "load_no", F.explode(F.array(*cells)).alias("c")).select("feed_id", "load_no", "c.*")

    def changes(self) -> DataFrame:
        """Marked changes of each load against the load before: null_rate, pattern, distinct, shares."""
        now = self.profile
        # Predecessor by shifting load_no: an equi-join on the profile's own key, one row per load.
        prev = now.select("feed_id", (F.col("load_no") + 1).alias("load_no"), "place", *[F.col(c).alias("p_" + c) for c in ("n_rows", "n_present", "n_distinct", "n_off_form")])
        both = now.join(prev, KEYS)
        some = (F.col("n_present") > 0) & (F.col("p_n_present") > 0)
        tests = {
            "null_rate": _differs(F.col("n_rows") - F.col("n_present"), F.col("n_rows"), F.col("p_n_rows") - F.col("p_n_present"), F.col("p_n_rows"), 15),
            "pattern": some & _differs(F.col("n_off_form"), F.col("n_present"), F.col("p_n_off_form"), F.col("p_n_present"), 15),
            "distinct": some & ((2 * F.col("n_distinct") < F.col("p_n_distinct")) | (F.col("n_distinct") > 2 * F.col("p_n_distinct"))),
        }
        marks = both.select(*KEYS, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("change"))
        # Shares: only a value with 25 % or more of one of the two loads can move that far, so at most
        # eight values per load and column are looked up in both; their rows are counted again where they are.
        pair = both.where(some).select(*KEYS, "n_present", "p_n_present")
        heavy = now.select(*KEYS, F.explode("heavy").alias("x")).select(*KEYS, "x.id", "x.n")
        after = lambda df: df.withColumn("load_no", F.col("load_no") + 1)
        touched = heavy.select(*KEYS, "id").unionByName(after(heavy.select(*KEYS, "id"))).distinct().join(pair.select(*KEYS), KEYS, "left_semi").checkpoint()
        sought = touched.unionByName(touched.withColumn("load_no", F.col("load_no") - 1)).distinct().checkpoint()
        known = self.cells.where("value IS NOT NULL").select(*KEYS, F.xxhash64("value").alias("id")).join(_side(sought), [*KEYS, "id"], "left_semi").groupBy(*KEYS, "id").agg(F.count("*").alias("n")).checkpoint()
        moved = (
            touched.join(pair, KEYS)
            .join(known, [*KEYS, "id"], "left")
            .join(after(known).withColumnRenamed("n", "p_n"), [*KEYS, "id"], "left")
            .where(_differs(F.coalesce("n", F.lit(0)), F.col("n_present"), F.coalesce("p_n", F.lit(0)), F.col("p_n_present"), 25))
            .select(*KEYS, F.lit("shares").alias("change"))
            .distinct()
        )
        return marks.unionByName(moved)

    def shares(self) -> DataFrame:
        """(feed, load, column, m, n, p): present rows and share of every pattern of a load."""
        m = self.masks.where("pattern IS NOT NULL").groupBy(*KEYS, F.col("pattern").alias("m")).agg(F.sum("n").alias("n"))
        return m.join(_side(self.profile.select(*KEYS, "n_present")), KEYS).withColumn("p", F.col("n") / F.col("n_present")).drop("n_present")

    def rare(self, below: float) -> DataFrame:
        """(feed, load, column, mask, n): the masks of a load below a share of its present values, one row each."""
        return self.named(self.shares().where(F.col("p") < below).select(*KEYS, F.col("m").alias("mask"), "n"))

    def report(self, rare: float = 0.02) -> DataFrame:
        """Per (feed, load, column): dominant mask and its share, rare masks and their rows, mask divergence from the load before.

        `divergence` is the Jensen-Shannon divergence (base 2, 0..1) between this load's
        collapsed-mask distribution and the one before; NULL for a first load.
        """
        dist = self.shares().checkpoint()
        low = F.col("p") < rare
        top = dist.groupBy(*KEYS).agg(F.max_by("m", F.struct("n", "m")).alias("top_mask"), F.round(F.max("p"), 6).alias("top_share"), F.count_if(low).alias("n_rare_masks"), F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("rare_mask_rows"))
        a, loads = dist.select(*KEYS, "m", "p"), _side(self.profile.where("n_present > 0").select(*KEYS))
        after = lambda df: df.withColumn("load_no", F.col("load_no") + 1)
        b = after(a).withColumnRenamed("p", "q").join(loads, KEYS, "left_semi")
        a = a.join(_side(after(self.profile.where("n_present > 0").select(*KEYS))), KEYS, "left_semi")
        mid = (F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))) / 2
        part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
        js = a.join(b, [*KEYS, "m"], "full_outer").groupBy(*KEYS).agg(F.round(F.sum(part("p") + part("q")) / 2, 6).alias("divergence"))
        return top.join(js, KEYS, "left")


def mined_forms(masks: DataFrame) -> DataFrame:
    """(place, form): the pattern most present values of a column have; one row per column."""
    m = masks.where("pattern IS NOT NULL").groupBy("place", "pattern").agg(F.sum("n").alias("n"))
    return m.groupBy("place").agg(F.max_by("pattern", F.struct("n", "pattern")).alias("form"))


def _differs(a: Column, na: Column, b: Column, nb: Column, percent: int) -> Column:
    """abs(a/na - b/nb) >= percent/100 in exact integers."""
    return F.lit(100) * F.abs(a * nb - b * na) >= F.lit(percent) * na * nb


def load_changes(df: DataFrame, columns: list[str], forms: Forms | None = None) -> DataFrame:
    """Marked changes of each load against the load before: null_rate, pattern, distinct, shares."""
    x = Loads(df, columns, forms)
    return x.named(x.changes())


def mask_report(df: DataFrame, columns: list[str], forms: Forms | None = None, rare: float = 0.02) -> DataFrame:
    """Per (feed, load, column): profile, ranges, dominant mask, rare masks, mask divergence, marked changes."""
    x = Loads(df, columns, forms)
    changes = x.changes().groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list("change")), ",").alias("changes"))  # at most four
    out = x.profile.join(x.ranges(), KEYS).join(x.report(rare), KEYS, "left").join(changes, KEYS, "left")
    return x.named(out).select(
        "feed_id", "load_no", "column_name", "n_rows", "n_present", F.round(1 - F.col("n_present") / F.col("n_rows"), 6).alias("null_rate"), "n_distinct", "min_value", "max_value", "n_off_form", "top_mask", "top_share", "n_rare_masks", "rare_mask_rows", "divergence", F.coalesce("changes", F.lit("")).alias("changes")
    )


def wide_profile(df: DataFrame, skip: tuple[str, ...] = ("feed_id", "load_no"), forms: Forms | None = None) -> DataFrame:
    """Every column per (feed, load): rows, present values, distinct count, smallest and largest value, values out of form."""
    x = Loads(df, [c for c in df.columns if c not in skip], forms)
    return x.named(x.profile.join(x.ranges(), KEYS)).select("feed_id", "load_no", "n_rows", "column_name", "n_present", "n_distinct", "min_value", "max_value", "n_off_form")
