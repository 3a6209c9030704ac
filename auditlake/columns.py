"""Column helpers: absence predicates, normalisers, guarded ratios.

Seven absence predicates exist on purpose; each names the layer it serves.
All take a Column or column name and return a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of absence, per layer.
SCAN_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ID_NA = ["", "nan", "nat", "none", "null", "n/a", "-"]
EVIDENCE_NA = ["", "NAN", "N/A", "NA", "NONE", "NULL", "NIL", "-", "--", "UNKNOWN"]
POPULATED_NA = ["", "nan", "nat", "none", "null"]
SUBMITTED_NA = ["", "n/a", "-", "--", "none", "null", "nan"]

WHITE = " \t\n\x0b\f\r"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(c).cast("string"), F.lit(WHITE))


def is_blank(c: Column | str) -> Column:
    """N1: null or white space only."""
    c = as_col(c)
    return c.isNull() | (strip(c) == "")


def is_scan_null(c: Column | str) -> Column:
    """N2: null or one of the reader's NA tokens, case-sensitive and untrimmed."""
    c = as_col(c).cast("string")
    return c.isNull() | c.isin(SCAN_NA)


def norm_id(c: Column | str) -> Column:
    """N3: trimmed identifier, NULL for absent spellings."""
    t = strip(c)
    return F.when(F.lower(t).isin(ID_NA), None).otherwise(t)


def vocab_key(c: Column | str) -> Column:
    """N4: trimmed vocabulary word in small letters; NULL if absent or unknown."""
    k = F.lower(strip(c))
    return F.when(~k.isin([*ID_NA, "unknown"]), k)


def has_evidence(c: Column | str) -> Column:
    """N5: a value that counts as evidence."""
    c = as_col(c)
    return c.isNotNull() & ~F.upper(strip(c)).isin(EVIDENCE_NA)


def is_populated(c: Column | str) -> Column:
    """N6: a value that counts as populated for capability coverage."""
    c = as_col(c)
    return c.isNotNull() & ~F.lower(strip(c)).isin(POPULATED_NA)


def is_mappable(c: Column | str) -> Column:
    """N7: a value the canonical projection accepts."""
    c = as_col(c)
    return c.isNotNull() & ~F.lower(strip(c)).isin(["", "nan"])


def is_submitted_absent(c: Column | str) -> Column:
    """Absent as the submitted tables spell it: null, or trimmed and lower-cased one of a few marks."""
    c = as_col(c).cast("string")
    return c.isNull() | F.lower(strip(c)).isin(SUBMITTED_NA)


def norm_value(c: Column | str) -> Column:
    """Upper-case token; blanks, hyphens, dots and slashes become one underscore; blank gives ''."""
    t = F.regexp_replace(F.regexp_replace(F.trim(as_col(c).cast("string")), r"[ .\-/]", "_"), "_+", "_")
    return F.coalesce(F.regexp_replace(F.upper(t), r"^_+|_+$", ""), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Sorted distinct runs of a-z and 0-9 after lower-casing; NULL when there is none."""
    a = all_tokens(c)
    return F.when(F.size(a) > 0, a)


def all_tokens(c: Column | str) -> Column:
    """The same, empty when there is none; Spark takes the tokens once instead of twice."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(as_col(c)), F.lit("([a-z0-9]+)"), F.lit(1))))


def rate(num: Column, den: Column, places: int = 6) -> Column:
    """num / den, NULL (never zero) when the denominator is zero."""
    return F.when(den > 0, F.round(num / den, places))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two arrays; 0 when both are empty."""
    u = F.size(F.array_union(as_col(a), as_col(b)))
    return F.when(u > 0, F.size(F.array_intersect(as_col(a), as_col(b))) / u).otherwise(F.lit(0.0))


def lookup(c: Column, pairs: dict[str, str]) -> Column:
    """Value of a literal map, NULL when the key is unknown."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(m, c)
