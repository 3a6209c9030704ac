"""Schemas that drift between files (problem 4).

Headers. The schema of a file is the union of its records' fields; the files carry no
header of their own, so it is read from the records, all files in parallel: each JSON
record is opened as a variant on the JVM, once, and every (file, field) keeps one bounded
summary: the join of its values' types, and what the values are (kind, for labels a
252-bit value sketch).

Lattice. A type is a set of the atoms boolean, whole, fraction, text, object, array; the
join is their union, so summaries fold in any order and merge over tasks, files, renames
and families alike. Read out: nothing is NULL, boolean, whole < number, object and array
stand alone, any other mixture is text.

Log. Successive files of a stream are compared field by field on those headers: renamed,
retyped, removed, added, in this order inside a file; the log is ordered by stream and file.

Table. The types of a field fold over all files of its family under the field's first
name into the union schema, and every record is cast to it.

Shuffles: one on (file, field) with map-side folding of fixed-size summaries, so a
file of any size moves as one row per task and field; all later steps work on one
row per (file, field), the table itself on one row per value.

Defined results: files without a stream or number are in no stream; unreadable or null
records have no fields; a field that is null in every record exists with no type and is
never `retyped`; a stream's first file has no changes; a missing file number compares
with the closest file before it; empty tables give no rows.
"""

from __future__ import annotations

from functools import cached_property
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import ensure_checkpoint_dir

SKETCH_WORDS = 4
NEAR_MAGNITUDE = 0.25  # numbers are alike within this distance of their ranges, in powers of ten
ALIKE = 0.5
BOOLEAN, WHOLE, FRACTION, TEXT, OBJECT, ARRAY = 1, 2, 4, 8, 16, 32


def open_records(rows: DataFrame) -> DataFrame:
    """(file_id, record_no, name, v): one row per field occurrence, `v` a variant."""
    spark = rows.sparkSession
    parsed = rows.select("file_id", "record_no", F.try_parse_json("record").alias("j")).where("j IS NOT NULL")
    return spark.sql("SELECT r.file_id, r.record_no, f.key AS name, f.value AS v FROM {r} r, LATERAL variant_explode(r.j) f WHERE f.key IS NOT NULL", r=parsed)


ATOMS = {"VOID": 0, "STRING": TEXT, "BOOLEAN": BOOLEAN, "OBJECT": OBJECT, "ARRAY": ARRAY, "TINYINT": WHOLE, "SMALLINT": WHOLE, "INT": WHOLE, "BIGINT": WHOLE}


def atoms(shape: Column) -> Column:
    """Lattice element of a variant from its schema text; 0 for a JSON null."""
    kind = F.regexp_extract(F.regexp_replace(shape, r"^DECIMAL\(\d+, ?0\)\z", "BIGINT"), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ATOMS.items() for x in kv]), kind), F.lit(FRACTION))


def _read(element: int, fine: bool) -> str | None:
    if element & ~(WHOLE | FRACTION) == 0:
        return None if element == 0 else "whole" if fine and element == WHOLE else "number"
    return {BOOLEAN: "boolean", OBJECT: "object", ARRAY: "array"}.get(element, "string")


def type_of(element: Column, fine: bool = False) -> Column:
    """Type a lattice element stands for: the JSON type, or with `fine` whole numbers apart from others."""
    return F.element_at(F.array(*[F.lit(_read(e, fine)).cast("string") for e in range(2 * ARRAY)]), element + 1)


def _short(c: Column) -> Column:
    """A description of bounded length that still tells all values apart."""
    one = F.transform(F.array(c), lambda x: F.when(F.length(x) <= 40, x).otherwise(F.concat(F.substring(x, 1, 8), F.md5(x))))  # taken once
    return F.element_at(one, 1)


def text_kind(s: Column) -> Column:
    """What a text is: time, prose, a code of letters and digits, digits, or a label."""
    code = F.regexp_replace(F.translate(s, ascii_uppercase + ascii_lowercase + digits, "A" * 26 + "a" * 26 + "9" * 10), "(A)A+|(a)a+", "$1$2")
    return (
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d([T ]|\z)"), "time")
        .when(s.rlike(r"^\s*\S+(?:\s+\S+){4}"), "prose")
        .when(s.rlike(r"^[0-9]+\z"), "digits")
        .when(s.rlike("[0-9]"), F.concat(F.lit("code:"), _short(code)))
        .otherwise("label")
    )


def number_kind(d: Column) -> Column:
    """Whole or fractional, with the order of magnitude."""
    return F.concat(F.when(d == F.floor(d), "int:").otherwise("frac:"), F.when(d == 0, "0").otherwise(F.floor(F.log10(F.abs(d))).cast("string")))


def kind_of(t: Column, text: Column, first: Column, num: Column, shape: Column) -> Column:
    """Content kind of one value; containers are described by their keys, or their element type and first element."""
    keys = F.regexp_replace(shape, r":\s*[A-Z]+(\([0-9, ]*\))?", "")
    return (
        F.when(t == "string", text_kind(text))
        .when(t == "number", number_kind(num))
        .when(t == "boolean", "boolean")
        .when(t == "array", F.concat(F.lit("array:"), F.coalesce(text_kind(first), _short(shape))))
        .when(t == "object", F.concat(F.lit("object:"), _short(keys)))
    )


def field_summaries(rows: DataFrame) -> DataFrame:
    """One row per (file, field): lattice element, dominant kind, value sketch, size of the numbers."""
    get = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    shape = F.schema_of_variant("v")
    # Through a one-row list, so that the parts of a value are taken once and not again in every branch below.
    parts = F.struct(shape.alias("shape"), atoms(shape).alias("e"), get("$", "string").alias("whole_text"), get("$[0]", "string").alias("first"), get("$", "double").alias("double_value"))
    c = open_records(rows).select("file_id", "name", F.inline(F.array(parts))).withColumn("t", type_of(F.col("e")))
    num = F.when(F.col("t") == "number", F.col("double_value"))
    c = c.select("file_id", "name", "e", kind_of(F.col("t"), F.col("whole_text"), F.col("first"), F.col("double_value"), F.col("shape")).alias("kind"), F.lower("whole_text").alias("text"), num.alias("num"))
    c = c.select("file_id", "name", F.inline(F.array(F.struct("e", "kind", F.when(F.col("kind") == "label", F.col("text")).alias("text"), "num"))))
    bit = F.pmod(F.xxhash64("text"), F.lit(63 * SKETCH_WORDS))
    word = lambda i: F.bit_or(F.when((F.col("kind") == "label") & (F.floor(bit / 63) == i), F.expr("shiftleft(1L, cast(pmod(xxhash64(text), 63) AS int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}")
    per_kind = c.groupBy("file_id", "name", "kind").agg(F.count("*").alias("n"), F.bit_or("e").alias("e"), F.min("num").alias("lo"), F.max("num").alias("hi"), *[word(i) for i in range(SKETCH_WORDS)])
    return per_kind.groupBy("file_id", "name").agg(
        F.bit_or("e").alias("element"),
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("kind"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[F.bit_or(f"s{i}").alias(f"s{i}") for i in range(SKETCH_WORDS)],
    ).withColumn("type", type_of(F.col("element")))


def _family(k: Column) -> Column:
    """Kind without magnitudes and inner digits."""
    return F.regexp_replace(k, r"^(int|frac):.*", "$1")


def likeness(a: str, b: str) -> Column:
    """0..1: how far two field summaries hold the same kind of content."""
    A, B = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    common = sum((F.bit_count(A(f"s{i}").bitwiseAND(B(f"s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    size = lambda X: sum((F.bit_count(X(f"s{i}")) for i in range(SKETCH_WORDS)), F.lit(0))
    overlap = F.try_divide(common, F.least(size(A), size(B)))
    middle = lambda X: F.log10(F.abs(X("lo")) + F.abs(X("hi")) + 1)
    same_type = A("type") == B("type")
    return (
        F.when(A("type").isNull() | B("type").isNull(), 0.0)
        .when(same_type & (A("kind") == "label") & (B("kind") == "label"), F.coalesce(overlap, F.lit(0.0)))
        .when(same_type & (A("type") == "number"), F.when((_family(A("kind")) == _family(B("kind"))) & (F.abs(middle(A) - middle(B)) <= NEAR_MAGNITUDE), 1 - F.abs(middle(A) - middle(B))).otherwise(0.0))
        .when(same_type & (A("kind") == B("kind")), 1.0)
        .otherwise(0.0)
    )


def successive(files: DataFrame) -> DataFrame:
    """(file_id, stream_id, seq_no, prev_id): each file with the one before it in its stream."""
    w = Window.partitionBy("stream_id").orderBy("seq_no", "file_id")
    f = files.where("file_id IS NOT NULL AND stream_id IS NOT NULL AND seq_no IS NOT NULL")
    return f.select("file_id", "stream_id", "seq_no", F.lag("file_id").over(w).alias("prev_id")).where("prev_id IS NOT NULL")


class Drift:
    """Headers of all files, read once, and what follows from them."""

    def __init__(self, files: DataFrame, rows: DataFrame, threshold: float = ALIKE) -> None:
        ensure_checkpoint_dir(rows.sparkSession)
        self.files, self.rows, self.threshold = files, rows, threshold

    @cached_property
    def headers(self) -> DataFrame:
        """One row per file and field; every step below starts from it."""
        return field_summaries(self.rows).checkpoint()

    @cached_property
    def log(self) -> DataFrame:
        """(stream_id, seq_no, file_id, change_no, change, old_name, new_name, old_type, new_type): the ordered change log."""
        s = self.headers
        attrs = [c for c in s.columns if c not in ("file_id", "name")]
        pre = lambda df, p: df.select("file_id", *[F.col(c).alias(f"{p}_{c}") for c in ["name", *attrs]])
        pairs = successive(self.files).select("file_id", "prev_id")
        new = pre(s, "n").join(pairs, "file_id")
        old = pre(s, "o").withColumnRenamed("file_id", "prev_id").join(pairs, "prev_id")
        both = new.drop("prev_id").withColumn("k", F.col("n_name")).join(old.drop("prev_id").withColumn("k", F.col("o_name")), ["file_id", "k"], "full_outer")
        # Only fields that differ go on: a few rows per file.
        differ = both.where("n_name IS NULL OR o_name IS NULL OR (o_type IS NOT NULL AND n_type IS NOT NULL AND o_type <> n_type)").checkpoint()
        row = lambda change, o, n, ot, nt: F.struct(F.lit(change).alias("change"), o.alias("old_name"), n.alias("new_name"), ot.alias("old_type"), nt.alias("new_type"))
        c, none = F.col, F.lit("")
        retyped = differ.where("o_name IS NOT NULL AND n_name IS NOT NULL").select("file_id", row("retyped", c("o_name"), c("n_name"), c("o_type"), c("n_type")).alias("r"))
        gone, come = differ.where("n_name IS NULL").select("file_id", *[f"o_{x}" for x in ["name", *attrs]]), differ.where("o_name IS NULL").select("file_id", *[f"n_{x}" for x in ["name", *attrs]])
        # Candidates exist only inside one file's few changed fields; the likest pair is taken first, then the likest of what is left.
        cand = gone.join(come, "file_id").withColumn("like", likeness("o", "n") + F.levenshtein(F.lower("o_name"), F.lower("n_name")) * F.lit(-0.0001)).where(F.col("like") >= self.threshold)
        listed = cand.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("like")).alias("far"), "o_name", "n_name", "o_type", "n_type"))).alias("cs"))
        greedy = """aggregate(cs, cast(array() AS array<struct<far:double,o_name:string,n_name:string,o_type:string,n_type:string>>), (done, x) ->
            CASE WHEN exists(done, d -> d.o_name = x.o_name OR d.n_name = x.n_name) THEN done ELSE concat(done, array(x)) END)"""
        picked = listed.select("file_id", F.explode(F.expr(greedy)).alias("x"))
        renamed = picked.select("file_id", row("renamed", c("x.o_name"), c("x.n_name"), c("x.o_type"), c("x.n_type")).alias("r"))
        left = lambda df, side: df.join(picked.select("file_id", F.col(f"x.{side}").alias(side)), ["file_id", side], "left_anti")
        removed = left(gone, "o_name").select("file_id", row("removed", c("o_name"), none, c("o_type"), F.lit(None).cast("string")).alias("r"))
        added = left(come, "n_name").select("file_id", row("added", none, c("n_name"), F.lit(None).cast("string"), c("n_type")).alias("r"))
        every = retyped.unionByName(renamed).unionByName(removed).unionByName(added).select("file_id", "r.*")
        rank = F.array_position(F.array(*map(F.lit, ("renamed", "retyped", "removed", "added"))), F.col("change"))
        w = Window.partitionBy("file_id").orderBy(rank, "old_name", "new_name")
        at = successive(self.files).select("file_id", "stream_id", "seq_no")
        return every.withColumn("change_no", F.row_number().over(w)).join(at, "file_id").select("stream_id", "seq_no", "file_id", "change_no", "change", "old_name", "new_name", "old_type", "new_type").checkpoint()

    @cached_property
    def names(self) -> DataFrame:
        """(file_id, name, field): the name each field had when it came into its stream.

        A stream's renames and additions fold over its files in order; from a file the walk
        goes back and stops where the name was added, so it never follows an earlier field
        of the same name. Where a file holds two fields that lead to the same name, the one
        that came in later is `name~seq_no` in its stream.
        """
        files = self.files.where("file_id IS NOT NULL")
        w = Window.partitionBy("stream_id").orderBy("seq_no", "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        step = self.log.where("change IN ('renamed', 'added')").groupBy("file_id", "seq_no").agg(F.map_from_entries(F.collect_list(F.struct("new_name", "old_name"))).alias("m")).select("file_id", F.struct("seq_no", "m").alias("step"))
        chain = files.select("file_id", "stream_id", "seq_no").join(step, "file_id", "left").withColumn("chain", F.collect_list("step").over(w))
        here = self.headers.select("file_id", "name").join(chain.select("file_id", "stream_id", "chain"), "file_id")
        walk = """aggregate(reverse(chain), named_struct('f', name, 'born', cast(0 AS bigint)), (s, x) -> CASE
            WHEN s.born > 0 OR try_element_at(x.m, s.f) IS NULL THEN s
            WHEN try_element_at(x.m, s.f) = '' THEN named_struct('f', s.f, 'born', cast(x.seq_no AS bigint))
            ELSE named_struct('f', try_element_at(x.m, s.f), 'born', s.born) END)"""
        led = here.withColumn("o", F.expr(walk)).select("file_id", "stream_id", "name", F.col("o.f").alias("f"), F.col("o.born").alias("born"))
        clash = led.groupBy("stream_id", "file_id", "f").agg(F.count("*").alias("n")).where("n > 1").select("stream_id", "f").distinct().withColumn("clash", F.lit(True))
        first = led.groupBy("stream_id", "f").agg(F.min("born").alias("first")).join(clash, ["stream_id", "f"])
        own = F.when(F.col("clash") & (F.col("born") > F.col("first")), F.concat("f", F.lit("~"), F.col("born").cast("string"))).otherwise(F.col("f"))
        return led.join(first, ["stream_id", "f"], "left").select("file_id", "name", own.alias("field")).checkpoint()

    @cached_property
    def schema(self) -> DataFrame:
        """(family, field, element, union_type, names, files, first_file, last_file): the lattice join over all files, per canonical field."""
        s = self.headers.select("file_id", "name", "element").join(self.names, ["file_id", "name"], "left").withColumn("field", F.coalesce("field", "name"))
        s = s.join(self._family(), "file_id", "left").fillna("", ["family"])
        g = s.groupBy("family", "field").agg(F.bit_or("element").alias("element"), F.array_sort(F.collect_set("name")).alias("names"), F.countDistinct("file_id").alias("files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
        return g.withColumn("union_type", type_of(F.col("element"), fine=True)).checkpoint()

    def _family(self) -> DataFrame:
        return self.files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.coalesce(F.max("family"), F.lit("")).alias("family"))

    def table(self) -> DataFrame:
        """Every record cast to its family's union schema: (file_id, record_no, fields map<string,variant>) under canonical names.

        A value whose field is text in the union schema becomes text, a whole number in a
        field of numbers a fraction; all others keep their type. Fields a record lacks, and
        all fields of an unreadable record, are null.
        """
        c = open_records(self.rows).withColumn("e", atoms(F.schema_of_variant("v"))).select("file_id", "record_no", "name", "e", F.to_json("v").alias("json"), F.expr("try_variant_get(v, '$', 'string')").alias("text"), F.expr("try_variant_get(v, '$', 'double')").alias("num"))
        c = c.join(self.names, ["file_id", "name"], "left").join(self._family(), "file_id", "left").withColumn("field", F.coalesce("field", "name")).fillna("", ["family"])
        cast = (
            F.when(F.col("e") == 0, None)
            .when((F.col("union_type") == "string") & (F.col("e") != TEXT), F.to_json(F.array(F.coalesce("text", "json"))))
            .when((F.col("union_type") == "number") & (F.col("e") == WHOLE), F.to_json(F.array("num")))
            .otherwise(F.concat(F.lit("["), F.col("json"), F.lit("]")))
        )
        # Each value travels as a one-element JSON list, opened again in the last step.
        cells = c.join(self.schema.select("family", "field", "union_type"), ["family", "field"]).select("file_id", "record_no", "field", cast.alias("value"))
        opened = cells.groupBy("file_id", "record_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
        every = self.schema.groupBy("family").agg(F.array_sort(F.collect_list("field")).alias("all_fields"))
        out = self.rows.select("file_id", "record_no").join(self._family(), "file_id", "left").fillna("", ["family"]).join(every, "family", "left").join(opened, ["file_id", "record_no"], "left")
        return out.select("file_id", "record_no", F.expr("map_from_arrays(coalesce(all_fields, array()), transform(coalesce(all_fields, array()), f -> variant_get(parse_json(try_element_at(m, f)), '$[0]', 'variant')))").alias("fields"))


def changes(files: DataFrame, rows: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(file_id, change, old_name, new_name) for every difference between successive files."""
    return Drift(files, rows, threshold).log.select("file_id", "change", "old_name", "new_name")


def file_headers(rows: DataFrame) -> DataFrame:
    """(file_id, name, type): the fields of every file with their JSON types."""
    return field_summaries(rows).select("file_id", "name", "type")


def union_schema(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Per family and canonical field: union type, the names it goes by, and where it occurs."""
    return Drift(files, rows).schema.drop("element")


def consistent_table(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every record in its family's union schema."""
    return Drift(files, rows).table()
