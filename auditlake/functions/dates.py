"""Dates on the JVM: parsing in a fixed order of formats, period buckets, chronology."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.columns import ID_NA, POPULATED_NA, as_col, strip

# Formats tried in this order after ISO 8601; the day comes before the month where both could be meant.
FORMATS = [
    "y-M-d H:m:s", "y-M-d H:m", "y-M-d", "d/M/y H:m:s", "d/M/y", "M/d/y H:m:s", "M/d/y",
    "y/M/d H:m:s", "y/M/d", "d-MMM-y H:m:s", "d-MMM-y", "y-M-d'T'H:m:s", "y-M-d'T'H:m",
]
PERIOD_FORMATS = ["y-M-d", "y-M-d'T'H:m:s", "y-M-d H:m:s", "y-M-d'T'H:m", "y-M-d H:m", "y/M/d", "d/M/y", "d-M-y"]
ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::\d\d(?::\d\d(?:[.,]\d{1,9})?)?)?(?:[+-]\d\d(?::?\d\d)?|[Zz])?)?\z"
# Every accepted format reads years of four digits and other numbers of one or two.
SHAPES = {"y": r"\d{4}", "M": r"\d{1,2}", "MMM": "[A-Za-z]{3}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}"}


def _shape(fmt: str) -> str:
    """Pattern of the texts a format may read: the parser alone would take longer numbers."""
    return "^" + re.sub(r"'T'|[A-Za-z]+|.", lambda m: "T" if m[0] == "'T'" else SHAPES.get(m[0], re.escape(m[0])), fmt) + r"\z"


def _iso(t: Column) -> Column:
    """ISO 8601 date or time; a zone is applied, without one the time is UTC."""
    day, clock = F.substring(t, 1, 10), F.regexp_extract(t, r"^.{10}[T ](\d\d(?::\d\d(?::\d\d)?)?)", 1)
    part = F.regexp_extract(t, r"[.,](\d{1,9})", 1)
    full = F.concat(F.rpad(clock, 2, "0"), F.when(F.length(clock) == 2, ":00:00").when(F.length(clock) == 5, F.concat(F.substring(clock, 3, 3), F.lit(":00"))).otherwise(F.substring(clock, 3, 6)))
    zone = F.regexp_extract(F.substring(t, 12, 60), r"([+-]\d\d(?::?\d\d)?|[Zz])\z", 1)
    zone = F.when(F.upper(zone) == "Z", "+00:00").when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    text = F.when(F.length(t) == 10, F.concat(day, F.lit(" 00:00:00"))).otherwise(F.concat(day, F.lit(" "), full, F.when(part != "", F.concat(F.lit("."), F.substring(part, 1, 6))).otherwise(""), zone))
    return F.when(t.rlike(ISO), text.try_cast("timestamp"))


def _parse(c: Column | str, formats: list[str], absent: list[str]) -> Column:
    c = as_col(c)
    kind = F.typeof(c)
    t = strip(c)
    t = F.when(~F.lower(t).isin(absent) & ~kind.isin("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") & ~kind.startswith("decimal"), t)
    return F.coalesce(_iso(t), *[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats])


def parse(c: Column | str, formats: list[str] | None = None) -> Column:
    """The instant of a text: ISO 8601, else the first format that reads it, naive times as UTC; NULL when none does.

    Numbers and booleans are no times, whatever their value.
    """
    return _parse(c, formats or FORMATS, ID_NA)


def parse_period(c: Column | str) -> Column:
    """The instant a period is derived from: ISO 8601, else a shorter list of formats, day first only."""
    return _parse(c, PERIOD_FORMATS, POPULATED_NA)


def parsed(c: Column | str) -> Column:
    """struct(canonical, original, naive_assumed_utc, parse_error); what has no instant is an error, absent values too."""
    t = parse(c)
    text = strip(c)
    has_zone = text.rlike(r"([Zz]|\d\d:\d\d[^+-]*[+-]\d\d(:?\d\d)?)$")
    return F.struct(t.alias("canonical"), text.alias("original"), (t.isNotNull() & ~has_zone).alias("naive_assumed_utc"), t.isNull().alias("parse_error"))


def first_of(*columns: str) -> Column:
    """The first readable time among several columns of a record."""
    return F.coalesce(*[parse_period(c) for c in columns])


def bucket(c: Column | str, granularity: str) -> Column:
    """Period label: year, quarter, month or day."""
    c = as_col(c)
    y = F.date_format(c, "yyyy")
    return {"year": y, "quarter": F.concat(y, F.lit("-Q"), F.quarter(c).cast("string")), "month": F.date_format(c, "yyyy-MM"), "day": F.date_format(c, "yyyy-MM-dd")}[granularity]


# Names of the impossible orders.
PAIRS = ("acknowledged_at < triggered_at", "closed_at < acknowledged_at", "closed_at < triggered_at")


def chronology(triggered: Column, acknowledged: Column, closed: Column) -> Column:
    """Impossible orders of trigger, acknowledgement and closure as an array of names; closure meets the trigger only without an acknowledgement."""
    tests = (acknowledged < triggered, closed < acknowledged, acknowledged.isNull() & (closed < triggered))
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, PAIRS)]))
