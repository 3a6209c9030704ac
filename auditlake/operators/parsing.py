"""Rows that fail to parse: valid records loaded, the others with their reason (problem 6).

A raw line is one comma-separated record. Quoting and column count are structural
and decided with JVM string functions on a skeleton of the line (each quoted
segment replaced by one mark). The two checked values are cast once per distinct
value into a dictionary of invalid values with reasons, which joins back.

Every line is parsed once: what was parsed is written to the checkpoint folder, the
dictionary and the result both start there. Lines meet their file's field order through
the few files whose header is not in the usual order, so lines are not shuffled by file
unless many files differ.

Defined results: line 1 of a file is its header and no record, whatever it holds; a
header without all nine names means the usual order; a null line has reason
`column_count`; an empty line has one empty field; repeated lines are judged one by one;
very long fields need no backtracking or recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import ensure_checkpoint_dir

# The record's fields in their usual order.
FIELDS = ["alert_id", "priority", "host", "created_time", "closed_time", "closed_by", "investigation_notes", "random_field", "department"]
Q, COMMA = "\u0001", "\u0002"


def skeleton(line: Column) -> Column:
    """The line with every quoted segment as one mark; an unpaired quote stays."""
    return F.regexp_replace(F.regexp_replace(F.translate(line, Q + COMMA, "  "), '"[^"]*"', Q), r"\r\z", "")


def bad_quoting(skel: Column) -> Column:
    """Unclosed quote, text after a closing quote, or a quote inside an unquoted field."""
    return skel.contains('"') | skel.rlike(f"[^,{Q}]{Q}|{Q}[^,{Q}]")


def fields(line: Column) -> Column:
    """Field texts of a well-quoted line: commas inside quotes are shielded, then split and unquoted."""
    parts = F.split(F.regexp_replace(F.translate(line, Q + COMMA, "  "), r"\r\z", ""), '"', -1)
    shielded = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", COMMA)).otherwise(p)), '"')
    unquote = lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.split(shielded, ",", -1), lambda f: F.translate(unquote(f), COMMA, ","))


def parse_lines(lines: DataFrame, columns: list[str] = FIELDS) -> DataFrame:
    """Structure of every record: (line_id, cse, file_no, line_no, structure | NULL, values of `columns`)."""
    base = lines.select("line_id", "cse", "file_no", "line_no", "raw_line")
    usual = F.array(*[F.lit(x) for x in FIELDS])
    heads = base.where("line_no = 1").select("file_no", F.transform(fields(F.col("raw_line")), lambda x: F.lower(F.trim(x))).alias("names"))
    heads = heads.where(F.size("names") == len(FIELDS)).groupBy("file_no").agg(F.min("names").alias("names")).where(F.col("names") != usual)
    s = base.where("line_no IS NULL OR line_no <> 1").withColumn("skel", skeleton(F.col("raw_line"))).join(heads, "file_no", "left").withColumn("names", F.coalesce("names", usual))
    n = F.length("skel") - F.length(F.translate("skel", ",", "")) + 1
    reason = F.when(F.col("raw_line").isNull(), "column_count").when(bad_quoting(F.col("skel")), "quoting").when(n != len(FIELDS), "column_count")
    s = s.withColumn("structure", reason)
    f = s.withColumn("f", F.when(F.col("structure").isNull(), fields(F.col("raw_line"))))
    pick = lambda name: F.try_element_at("f", F.array_position("names", F.lit(name)).cast("int"))
    at = {name: F.when(F.array_contains("names", F.lit(name)), pick(name)) for name in columns}
    return f.select("line_id", "cse", "file_no", "line_no", "structure", *[v.alias(k) for k, v in at.items()])


def invalid_values(parsed: DataFrame) -> DataFrame:
    """(column_name, value, reason): each distinct value of the checked columns cast once, only the invalid kept."""
    cells = parsed.where("structure IS NULL").select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.trim(F.col(c)), F.lit("")).alias("value")) for c in ("alert_id", "closed_time")])).alias("c"))
    d = cells.select("c.*").groupBy("column_name", "value").agg(F.count("*").alias("uses"))
    digits = F.regexp_replace("value", "^0+(?=[0-9])", "")
    minutes = F.when((F.length(digits) <= 6) & F.col("value").rlike(r"^[0-9]+\z"), digits.cast("int"))
    ok = F.when(F.col("column_name") == "alert_id", F.col("value").rlike(r"^TST-[0-9]{9}\z")).otherwise((F.col("value") == "") | F.coalesce(minutes.between(0, 525600), F.lit(False)))
    return d.where(~ok).select("column_name", "value", F.col("column_name").alias("reason"))


def _judged(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Every record with its first reason (NULL: it loads) and the values of `columns`."""
    ensure_checkpoint_dir(lines.sparkSession)
    parsed = parse_lines(lines, columns).checkpoint()
    bad = invalid_values(parsed).checkpoint()  # the dictionary: only invalid values
    out = parsed
    for c in ("alert_id", "closed_time"):
        d = bad.where(F.col("column_name") == c).select(F.col("value").alias(f"k_{c}"), F.col("reason").alias(f"r_{c}"))
        out = out.withColumn(f"k_{c}", F.when(F.col("structure").isNull(), F.coalesce(F.trim(F.col(c)), F.lit("")))).join(d, f"k_{c}", "left")
    return out.select("line_id", "cse", F.coalesce("structure", "r_alert_id", "r_closed_time").alias("reason"), *columns)


def judge_lines(lines: DataFrame, columns: list[str] = FIELDS) -> DataFrame:
    """Every record with its first reason (NULL: it loads) and its values; the two checked ones always come along."""
    return _judged(lines, [c for c in FIELDS if c in {"alert_id", "closed_time", *columns}])


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that do not load."""
    return _judged(lines, ["alert_id", "closed_time"]).where("reason IS NOT NULL").select("line_id", "reason")


def loaded(lines: DataFrame) -> DataFrame:
    """The valid records as a typed table."""
    ok = judge_lines(lines).where("reason IS NULL")
    return ok.select("line_id", "cse", F.trim("alert_id").alias("alert_id"), "priority", "host", "created_time", F.expr("try_cast(trim(closed_time) AS int)").alias("closed_minutes"), "closed_by", "investigation_notes", "random_field", "department")
