"""Texts rendered from columns at the end of a plan: ordinals, probability phrases, templates, list fields."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    last, two = n % 10, n % 100
    end = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def shown_probability(p: Column) -> Column:
    """Six places; anything below 1e-4 shows as 0.0."""
    return F.when(p < 1e-4, 0.0).otherwise(F.round(p, 6))


def probability_phrase(log10_p: Column) -> Column:
    """About one in ten to some power, or the share itself when it is not small."""
    return F.when(log10_p <= -4, F.concat(F.lit("about 1 in 10^"), F.floor(-log10_p).cast("string"))).otherwise(F.format_string("%.4f", F.pow(F.lit(10.0), log10_p)))


def template(text: str, columns: list[str]) -> Column:
    """`{name}` places filled from columns at plan time; an unknown place is an error, a NULL shows as '-'."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", text)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in columns:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("-")))
        else:
            raise ValueError(f"no column {piece!r} for the template")
    return F.concat(*parts)


def listed(c: Column) -> Column:
    """Comma- or space-separated field as an array of upper-case tokens."""
    return F.filter(F.split(F.upper(c), r"[,;\s]+"), lambda x: x != "")


def fingerprint(value: object) -> str:
    """Digest of any JSON value, keys sorted."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()
