"""Freely typed values mapped to a reference list by a pigeonhole join (problem 5). SQL only.

Values are reduced to distinct ones first (map-side combined), then to words: look-alike
letters to their prototypes, lower case, punctuation and spaces as separators. A value
means an entry if its words are the entry's words in any order, or its letters without
spaces are, or if all its words pair off with the entry's words with at most `SLIPS`
slips in words of five or more letters. A number, a word in brackets, a word before a colon
or after a dash may be left out by rule; single marking words are a parameter (`Marks`).

Slips are one letter missing, added, changed, or two neighbours swapped. A swap is two
edits, so two slips are at most four edits: each reference word is cut into five
segments, one of which must occur unharmed in the typed word at a position at most two
off. Candidates come from an equality join on (list, segment, position); built-in
levenshtein on the words and on their one-swap variants verifies them. Values without a
match come out by anti-join.

Cost: one shuffle of distinct (column, value) counts; everything else works on distinct
words. Rows receive their entry by a join on (column, value) with a unique right side,
broadcast while it has at most `BROADCAST_VALUES` rows; beyond that only the few values
that many rows hold are broadcast and the others shuffled, so no task receives a hot value.

Defined results: absent values and exact labels give no row; a value that matches two
entries equally well takes the smaller item_id; rows without an id are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import is_submitted_absent
from auditlake.llm.lookalike import PROTOTYPES
from auditlake.session import ensure_checkpoint_dir

SLIPS, EDITS, LEAST_LETTERS = 2, 4, 5
SEGMENTS = EDITS + 1
BROADCAST_VALUES, PARTS = 200_000, 500  # distinct values up to which the answers are broadcast; beyond, values above 1/PARTS of the rows are


@dataclass(frozen=True)
class Marks:
    """Words that mark a value without changing what it means, before and after it."""

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()

    def patterns(self) -> tuple[str, str]:
        """What may be cut from the start and from the end of a value."""
        words = lambda ws: "(?:" + "|".join(map(re.escape, ws)) + ")"
        start = [rf"{words(self.before)}\b[\s.:=\-]*"] if self.before else []
        end = [rf"[\s\-,(\[]*\b{words(self.after)}\b[)\].!?\s]*"] if self.after else []
        return "^(?:" + "|".join([*start, r"\p{L}+\s*[:=]\s*", r"#?\s*[0-9]+[.):]?\s+"]) + ")", "(?:" + "|".join([*end, r"\s*[(\[]\s*\p{L}+\s*[)\]]", r"\s+-\s+\p{L}+", r"(?:\s+#?|\s*#)\s*[0-9]+"]) + ")$"


# Doubt and kind, as analysts write them; a caller with other habits passes their own.
USUAL = Marks(
    ("suspected", "possible", "possibly", "poss", "probable", "probably", "likely", "type", "cat", "category"),
    ("confirmed", "unconfirmed", "tbc", "suspected"),
)


def _translation() -> tuple[str, str]:
    wide = {chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}
    pairs = {k: v for k, v in {**PROTOTYPES, **wide}.items() if len(v) == 1}
    return "".join(pairs), "".join(pairs.values())


DRAWN_LIKE, DRAWN_AS = _translation()


def plain(c: Column) -> Column:
    """Small letters with look-alikes as their prototypes and invisible characters removed."""
    return F.lower(F.translate(F.regexp_replace(c, r"\p{Cf}", ""), DRAWN_LIKE, DRAWN_AS))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words(c: Column) -> Column:
    """Runs of letters and digits of a value."""
    return _words(plain(c))


def unmarked(c: Column, marks: Marks = USUAL) -> Column:
    """Words of a value without one marking word or number before or after them."""
    before, after = marks.patterns()
    return _words(F.regexp_replace(F.regexp_replace(F.trim(plain(c)), before, ""), after, ""))


def reference_names(items: DataFrame) -> DataFrame:
    """(list_name, item_id, name_id, ws): one row per label or other name."""
    n = items.select("list_name", "item_id", F.explode(F.concat(F.array("label"), F.coalesce(F.split("other_names", r"\|"), F.array().cast("array<string>")))).alias("name")).where("name IS NOT NULL")
    n = n.withColumn("ws", words(F.col("name"))).where(F.size("ws") > 0).drop("name").distinct()
    return n.withColumn("name_id", F.xxhash64("list_name", "item_id", F.array_join("ws", " ")))


def typed_values(df: DataFrame, items: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, column_name, value): present values that are not exactly a label of their list."""
    cells = df.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~is_submitted_absent(c), F.col(c)).alias("value")) for c in columns])).alias("c"),
    ).select("row_id", "c.*").where("value IS NOT NULL")
    labels = items.select(F.col("list_name").alias("column_name"), F.col("label").alias("value")).distinct()
    return cells.join(F.broadcast(labels), ["column_name", "value"], "left_anti")  # the reference list is a fixed table


def similar_words(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(list_name, w, r, slips): typed words within the slips of a reference word.

    Pigeonhole: of the reference word's segments at least one is untouched by the edits.
    """
    r = known.where(F.length("r") >= LEAST_LETTERS)
    cut = lambda i: F.floor(F.length("r") * i / SEGMENTS).cast("int")
    segs = F.array(*[F.struct(F.lit(i).alias("seg"), (cut(i) + 1).alias("at"), F.col("r").substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(SEGMENTS)])
    rs = r.select("list_name", "r", F.explode(segs).alias("s")).select("list_name", "r", "s.at", "s.piece", F.length("s.piece").alias("width"), F.length("r").alias("size"))
    rs = rs.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - SLIPS), F.col("at") + SLIPS)).alias("pos"))
    shapes = rs.select("list_name", "width").distinct().groupBy("list_name").agg(F.collect_set("width").alias("widths"))  # a handful of widths per list
    t = typed.where(F.length("w") >= LEAST_LETTERS - SLIPS).join(shapes, "list_name")
    ts = t.select("list_name", "w", F.explode("widths").alias("width")).where(F.col("width") <= F.length("w")).select("list_name", "w", "width", F.explode(F.expr("sequence(1, length(w) - width + 1)")).alias("pos"))
    ts = ts.withColumn("piece", F.expr("substr(w, pos, width)"))
    cand = ts.join(rs, ["list_name", "width", "pos", "piece"]).where(F.abs(F.length("w") - F.col("size")) <= SLIPS).select("list_name", "w", "r").distinct()
    cand = cand.withColumn("lev", F.levenshtein("w", "r", EDITS)).where("lev >= 0")
    swaps = "transform(sequence(1, length({x}) - 1), i -> concat(substr({x}, 1, i - 1), substr({x}, i + 1, 1), substr({x}, i, 1), substr({x}, i + 2)))"
    cand = cand.withColumn("sw", F.expr(swaps.format(x="w"))).withColumn("sr", F.expr(swaps.format(x="r")))
    slips = (
        F.when(F.col("lev") <= 1, F.col("lev"))
        .when(F.array_contains("sw", F.col("r")), 1)
        .when(F.col("lev") <= 2, 2)
        .when(F.exists("sw", lambda x: F.levenshtein(x, F.col("r")) <= 1) | F.exists("sr", lambda x: F.levenshtein(F.col("w"), x) <= 1) | F.arrays_overlap("sw", "sr"), 2)
    )
    return cand.select("list_name", "w", "r", slips.alias("slips")).where("slips IS NOT NULL")


def meanings(values: DataFrame, items: DataFrame, marks: Marks = USUAL) -> DataFrame:
    """(column_name, value, item_id) of the distinct values that mean an entry.

    `values` holds distinct (column_name, value).
    """
    names = reference_names(items)
    v = values.select("column_name", "value", F.explode(F.array(F.struct(F.lit(0).alias("cut"), words(F.col("value")).alias("ws")), F.struct(F.lit(1).alias("cut"), unmarked(F.col("value"), marks).alias("ws")))).alias("x"))
    v = v.select("column_name", "value", "x.*").where(F.size("ws") > 0).withColumn("vid", F.xxhash64("column_name", "value", "cut"))
    # Same words in any order, or the same letters without spaces.
    bag, run = (lambda c: F.array_join(F.array_sort(c), " ")), (lambda c: F.array_join(c, ""))
    keys = lambda c: F.explode(F.array_distinct(F.array(F.concat(F.lit("w "), bag(c)), F.concat(F.lit("r "), run(c)))))
    exact = v.select("column_name", "value", "cut", keys(F.col("ws")).alias("k")).join(names.select(F.col("list_name").alias("column_name"), "item_id", keys(F.col("ws")).alias("k")).distinct(), ["column_name", "k"])
    exact = exact.select("column_name", "value", "item_id", F.lit(0).alias("slips"), "cut")
    # Word by word with slips.
    vw = v.select(F.col("column_name").alias("list_name"), "value", "cut", "vid", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    nw = names.select("list_name", "item_id", "name_id", F.size("ws").alias("n"), F.posexplode("ws").alias("j", "r"))
    typed, known = vw.select("list_name", "w").distinct(), nw.select("list_name", "r").distinct()
    same = typed.join(known.withColumn("w", F.col("r")), ["list_name", "w"]).select("list_name", "w", "r", F.lit(0).alias("slips"))
    near = similar_words(typed, known).where("slips > 0").unionByName(same)
    hit = vw.join(near, ["list_name", "w"]).join(nw, ["list_name", "r", "n"])
    by_i = hit.groupBy("vid", "name_id", "i").agg(F.min("slips").alias("s")).groupBy("vid", "name_id").agg(F.count("*").alias("ni"), F.sum("s").alias("si"))
    by_j = hit.groupBy("vid", "name_id", "j").agg(F.min("slips").alias("s")).groupBy("vid", "name_id").agg(F.count("*").alias("nj"), F.sum("s").alias("sj"))
    whole = by_i.join(by_j, ["vid", "name_id"]).where((F.col("si") <= SLIPS) & (F.col("sj") <= SLIPS))
    ends = hit.select("vid", "name_id", F.col("list_name").alias("column_name"), "value", "cut", "item_id", "n").distinct()
    fuzzy = ends.join(whole, ["vid", "name_id"]).where("ni = n AND nj = n").select("column_name", "value", "item_id", F.greatest("si", "sj").cast("int").alias("slips"), "cut")
    best = F.min_by("item_id", F.struct("slips", "cut", "item_id"))
    return exact.unionByName(fuzzy).groupBy("column_name", "value").agg(best.alias("item_id"))


def map_values(df: DataFrame, items: DataFrame, columns: list[str], marks: Marks = USUAL) -> DataFrame:
    """(row_id, column_name, item_id): the entry each typed value means, `none` for the unmatched."""
    cells = typed_values(df, items, columns)
    ensure_checkpoint_dir(df.sparkSession)
    # Distinct values and their meanings are stored: each is read several times below.
    on = ["column_name", "value"]
    distinct = cells.groupBy(*on).agg(F.count("*").alias("n")).checkpoint()
    found = meanings(distinct.select(*on), items, marks).checkpoint()
    answers = found.unionByName(distinct.select(*on).join(found, on, "left_anti").withColumn("item_id", F.lit("none")))
    size = distinct.agg(F.count("*").alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size["values"] <= BROADCAST_VALUES:
        return cells.join(F.broadcast(answers), on).select("row_id", "column_name", "item_id")
    # Beyond that rows are shuffled by value, but for the values that would fill a task: at most PARTS of them.
    hot = distinct.where(F.col("n") * PARTS > size["rows"]).select(*on)
    often = cells.join(F.broadcast(answers.join(F.broadcast(hot), on, "left_semi")), on)
    seldom = cells.join(F.broadcast(hot), on, "left_anti").join(answers, on)
    return often.unionByName(seldom).select("row_id", "column_name", "item_id")


def unmatched_report(df: DataFrame, items: DataFrame, columns: list[str], marks: Marks = USUAL) -> DataFrame:
    """(column_name, value, rows): values that mean no entry, with how many rows hold them."""
    ensure_checkpoint_dir(df.sparkSession)
    distinct = typed_values(df, items, columns).groupBy("column_name", "value").agg(F.count("*").alias("n_rows")).checkpoint()
    return distinct.join(meanings(distinct.select("column_name", "value"), items, marks), ["column_name", "value"], "left_anti")
