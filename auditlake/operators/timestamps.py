"""Mixed timestamp notations and time zones brought to one UTC instant (problem 3).

The layout of every value (its digits as one mark) is taken on the JVM. A layout is read
once per Arrow batch by a small grammar that finds the positions of year, month, day,
clock, fraction, offset and zone; all values of the layout are then cut from the Arrow
buffer and converted as numpy arrays. Local times meet the transitions of their zone by
array search.

Format mixtures. A source (entity) writes in a mixture of formats. Every value contributes
the set of formats under which it is a valid date, and expectation-maximisation over these
sets gives the source's format weights: a value valid under one format counts for it, a
value valid under several is shared by posterior. The posterior of a value decides its
interpretation; a declared date order is a certain prior that excludes the other order.
Without one, an interpretation is taken only if its posterior reaches `CERTAIN`, otherwise
the value is marked ambiguous. Day and month are the only formats that share values, so
the posterior is the same for all values of a source that both orders can read.

Cost: one pass over the values, one pre-pass that counts format sets per source (map-side
combined), no shuffle of values. The per-source table is broadcast while it has at most
`BROADCAST_SOURCES` rows and joined by shuffle beyond.

Defined results: absent values give no row; a local time whose source has no known
zone is `unreadable`; hours after a creation time inherit that time's reason when it
has no instant; extra columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import SUBMITTED_NA
from auditlake.session import ensure_checkpoint_dir, ship_package

CERTAIN = 0.9
BROADCAST_SOURCES = 100_000
# White space that is cut from both ends, as a regular expression sees it.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()
DAYS = "mon tue wed thu fri sat sun".split()
_DIGITS = str.maketrans("0123456789", "9999999999")

_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?"
_OFF = r"(?P<o>[+-]99(?::?99)?)"
_GRAMMAR = [
    ("ymd", re.compile(rf"(?P<y>9999)-(?P<mo>99)-(?P<d>99)(?:[Tt ]{_CLOCK} ?(?:(?P<z>[Zz])|{_OFF}(?:\[[\w/+\-]+\])?|(?P<ab>[A-Za-z]{{2,5}}))?)?")),
    ("ymd", re.compile(r"(?P<y>9999)(?P<mo>99)(?P<d>99)[Tt](?P<h>99)(?P<mi>99)(?P<s>99)?(?P<z>[Zz])?")),
    ("slash", re.compile(rf"(?P<a>99?)/(?P<b>99?)/(?P<y>9999)(?:,? {_CLOCK}(?: ?(?P<ap>[AaPp][Mm]))?)?")),
    ("dmy", re.compile(rf"(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999)(?:,? {_CLOCK}(?: ?(?P<ap>[AaPp][Mm]))?)?")),
    ("named", re.compile(rf"(?:(?P<wd>[A-Za-z]{{3,9}}), )?(?P<d>99?) (?P<mn>[A-Za-z]{{3,9}}) (?P<y>9999)(?:,? {_CLOCK}(?: ?(?P<ap>[AaPp][Mm]))?(?: (?:(?P<z>[Zz])|{_OFF}|(?P<ab>[A-Za-z]{{2,5}})))?)?")),
    ("named", re.compile(rf"(?:(?P<wd>[A-Za-z]{{3,9}}), )?(?P<mn>[A-Za-z]{{3,9}}) (?P<d>99?),? (?P<y>9999)(?:,? {_CLOCK}(?: ?(?P<ap>[AaPp][Mm]))?(?: (?:(?P<z>[Zz])|{_OFF}|(?P<ab>[A-Za-z]{{2,5}})))?)?")),
    ("epoch_s", re.compile(r"(?P<n>9{10})")),
    ("epoch_ms", re.compile(r"(?P<n>9{13})")),
    ("ymd", re.compile(r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<h>99)(?P<mi>99)(?P<s>99)")),
    ("hours", re.compile(r"(?P<n>9{1,4})")),
]


@lru_cache(maxsize=4096)
def read_layout(layout: str):
    """(kind, match) of the first grammar rule that reads the whole layout, or None."""
    if layout.isascii():
        for kind, rule in _GRAMMAR:
            if m := rule.fullmatch(layout):
                return kind, m
    return None


@lru_cache(maxsize=1024)
def _zone(name: str):
    from zoneinfo import ZoneInfo

    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001  an unknown zone name is data, not a failure
        return None


SPAN = 315_569_520  # ten mean years in seconds
DAY = 86_400
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


@lru_cache(maxsize=4096)
def _transitions(zone: str, span: int):
    """Changes of a zone in a span of ten years: local times where a change begins and ends, offsets and names between them."""
    z = _zone(zone)

    def at(second: int) -> tuple[int, str]:
        t = (_EPOCH + dt.timedelta(seconds=second)).astimezone(z)
        return int(t.utcoffset().total_seconds()), (t.tzname() or "").upper()

    first, last = max(span * SPAN - 3 * DAY, -62_000_000_000), min((span + 1) * SPAN + 3 * DAY, 253_000_000_000)
    begin, end, kept = [], [], [at(first)]
    for day in range(first, last, DAY):
        if (now := at(day + DAY)) != kept[-1]:
            lo, hi = day, day + DAY
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if at(mid) != kept[-1] else (mid, hi)
            begin.append(hi + min(kept[-1][0], now[0]))
            end.append(hi + max(kept[-1][0], now[0]))
            kept.append(now)
    return np.array(begin, np.int64), np.array(end, np.int64), np.array([o for o, _ in kept], np.int64), np.array([n for _, n in kept], object)


@lru_cache(maxsize=20_000)
def _abbreviation(zone: str, year: int, name: str):
    """Offset that `name` stands for in a zone around a year, or None."""
    z = _zone(zone)
    for month in range(1, 13):
        t = dt.datetime(year, month, 15, tzinfo=z)
        if (t.tzname() or "").upper() == name:
            return int(t.utcoffset().total_seconds())
    return 0 if name in ("UTC", "GMT", "Z") else None


def _groups(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(code, positions) of every code from 0 up."""
    order = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[order], return_index=True)
    for c, idx in zip(found, np.split(order, starts[1:])):
        if c >= 0:
            yield int(c), idx


def _days_in_month(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    table = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.where((m == 2) & leap, 29, table[np.clip(m, 0, 12)])


def _day_number(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    return ((y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)).astype("datetime64[D]").astype(np.int64) + d - 1


def _ints(chars: np.ndarray, m: re.Match, name: str) -> np.ndarray | None:
    if name not in m.re.groupindex or m.start(name) < 0:
        return None
    out = np.zeros(len(chars), np.int64)
    for i in range(m.start(name), m.end(name)):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


OK, AMBIGUOUS, NONEXISTENT, UNREADABLE = 0, 1, 2, 3
REASONS = np.array(["", "ambiguous", "nonexistent", "unreadable"], dtype=object)


def _resolve_local(local: np.ndarray, zones: np.ndarray, names: list[str], abbr: str, status: np.ndarray, seconds: np.ndarray) -> None:
    """Local seconds of each row's zone to UTC seconds; sets status where no single instant exists."""
    status[zones < 0] = UNREADABLE
    for code, own in _groups(zones):
        if _zone(names[code]) is None:
            status[own] = UNREADABLE
            continue
        for span, at in _groups(local[own] // SPAN - (low := int((local[own] // SPAN).min()))):
            idx = own[at]
            begin, end, offsets, called = _transitions(names[code], span + low)
            t = local[idx]
            i0, i1 = np.searchsorted(end, t, "right"), np.searchsorted(begin, t, "right")  # before and after a change the time falls into
            o0, o1 = offsets[i0], offsets[i1]
            if not abbr:
                seconds[idx] = t - o0
                status[idx[o0 > o1]], status[idx[o0 < o1]] = AMBIGUOUS, NONEXISTENT
                continue
            n0, n1 = called[i0] == abbr, called[i1] == abbr
            seconds[idx] = t - np.where(n0, o0, o1)
            for i in np.flatnonzero(~(n0 | n1) & (o0 >= o1)):  # a name the zone does not use at this time
                fixed = _abbreviation(names[code], 1970 + int(t[i] // 31_556_952), abbr)
                if fixed is None:
                    status[idx[i]] = UNREADABLE
                else:
                    seconds[idx[i]] = t[i] - fixed
            status[idx[o0 < o1]] = NONEXISTENT


DMY, MDY = 1, 2


def parse_values(values: pd.Series, zones: pd.Series, orders: pd.Series, hours_after: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """UTC microseconds and status of every value of a Series; `orders` holds DMY, MDY or None (undecided)."""
    text = [v.strip(BLANKS) if isinstance(v, str) else None for v in values]
    layout = pa.array([None if v is None else v.translate(_DIGITS) for v in text], pa.string())
    return parse_texts(pa.array(text, pa.string()), layout, pa.array(list(zones), pa.string()), pa.array(list(orders), pa.string()), hours_after)


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes (-1: null) and values of a string column."""
    d = column.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _chars(text: pa.Array, idx: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) bytes of ASCII texts of one length, straight from the Arrow buffer."""
    t = text.take(pa.array(idx))
    at = np.frombuffer(t.buffers()[1], np.int32)[t.offset]
    return np.frombuffer(t.buffers()[2], np.uint8)[at : at + len(idx) * width].reshape(len(idx), width)


def parse_texts(text: pa.Array, layout: pa.Array, zones: pa.Array, orders: pa.Array, hours_after: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """UTC microseconds and status of every trimmed text with its layout.

    `hours_after` is (microseconds, status, present) of the column that up to four digits
    count hours from.
    """
    n = len(text)
    seconds, micros, status = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, UNREADABLE, np.int8)
    zone_arr, zone_names = _coded(zones)
    codes, listed = _coded(orders)
    order_arr = np.array([{"DMY": DMY, "MDY": MDY}.get(x, 0) for x in listed] + [0], np.int8)[codes]
    layout_codes, layouts = _coded(layout)
    for code, idx in _groups(layout_codes):
        layout = layouts[code]
        found = read_layout(layout) if layout else None
        if found is None:
            continue
        kind, m = found
        chars = _chars(text, idx, len(layout))
        st, sec, mic = np.zeros(len(idx), np.int8), np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
        if kind in ("epoch_s", "epoch_ms"):
            v = _ints(chars, m, "n")
            sec, mic = (v, mic) if kind == "epoch_s" else (v // 1000, v % 1000 * 1000)
        elif kind == "hours":
            if hours_after is None:
                continue
            base, base_status, present = (x[idx] for x in hours_after)
            st = np.where(present, base_status, UNREADABLE).astype(np.int8)
            sec, mic = base // 1_000_000 + _ints(chars, m, "n") * 3600, base % 1_000_000
        else:
            part = lambda name: _ints(chars, m, name)
            y = part("y")
            if kind == "slash":
                a, b = part("a"), part("b")
                o = order_arr[idx]
                mdy = o == MDY
                mo, d = np.where(mdy, a, b), np.where(mdy, b, a)
                undecided = o == 0
                ok_dmy, ok_mdy = (b >= 1) & (b <= 12) & (a >= 1) & (a <= _days_in_month(y, b)), (a >= 1) & (a <= 12) & (b >= 1) & (b <= _days_in_month(y, a))
                swap = undecided & ok_mdy & ~ok_dmy
                mo, d = np.where(swap, a, mo), np.where(swap, b, d)
                st[undecided & ok_mdy & ok_dmy & (a != b)] = AMBIGUOUS
            elif kind == "named":
                name = m.group("mn").lower()
                mo = np.full(len(idx), (MONTHS.index(name) if name in MONTHS else LONG_MONTHS.index(name) if name in LONG_MONTHS else 8 if name == "sept" else -1) + 1)
                d = part("d")
                if (wd := m.group("wd")) and wd.lower()[:3] not in DAYS:
                    mo[:] = 0
            else:
                mo, d = part("mo"), part("d")
            h, mi, s = (x if (x := part(k)) is not None else np.zeros(len(idx), np.int64) for k in ("h", "mi", "s"))
            good = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= _days_in_month(y, mo)) & (mi < 60) & (s < 60)
            groups = m.groupdict()
            if ap := groups.get("ap"):
                good &= (h >= 1) & (h <= 12)
                h = h % 12 + (12 if ap.lower() == "pm" else 0)
            good &= h < 24
            if groups.get("f"):
                f = np.zeros(len(idx), np.int64)
                for k in range(6):
                    p = m.start("f") + k
                    f = f * 10 + ((chars[:, p].astype(np.int64) - 48) if p < m.end("f") else 0)
                mic = f
            st[~good] = UNREADABLE
            mo, d, y = np.where(good, mo, 1), np.where(good, d, 1), np.where(good, y, 1970)
            local = _day_number(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
            open_ = st == OK
            if groups.get("z"):
                sec = local
            elif groups.get("o"):
                at, end = m.start("o"), m.end("o")
                digits = [p for p in range(at + 1, end) if layout[p] == "9"]
                v = [chars[:, p].astype(np.int64) - 48 for p in digits]
                oh, om = v[0] * 10 + v[1], (v[2] * 10 + v[3]) if len(v) == 4 else 0
                st[open_ & ((oh > 18) | (om > 59))] = UNREADABLE
                sec = local - np.where(chars[:, at] == ord("-"), -1, 1) * (oh * 3600 + om * 60)
            else:
                sub_st, sub_sec = st[open_], sec[open_]
                _resolve_local(local[open_], zone_arr[idx][open_], zone_names, (groups.get("ab") or "").upper(), sub_st, sub_sec)
                st[open_], sec[open_] = sub_st, sub_sec
        seconds[idx], micros[idx], status[idx] = sec, mic, st
    return seconds * 1_000_000 + micros, status


def render(us: np.ndarray, status: np.ndarray) -> np.ndarray:
    """UTC text of each instant, or the reason why there is none."""
    out = REASONS[status].copy()
    ok = status == OK
    out[ok] = np.char.add(np.datetime_as_string(us[ok].astype("datetime64[us]"), unit="us").astype(str), "Z") if ok.any() else out[ok]
    return out


def _normalise(odd_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of `_prepared` to one row per value that is not absent."""
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            flag = lambda n: c[n].fill_null(False).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            created = parse_texts(c["created_text"], c["created_layout"], c["tz"], c["date_order"])
            parts = [("created_time", "created", *created)]
            if flag("closed_present").any():
                parts.append(("closed_time", "closed", *parse_texts(c["closed_text"], c["closed_layout"], c["tz"], c["date_order"], (*created, flag("created_present")))))
            for name, short, us, st in parts:
                keep = flag(f"{short}_present")
                if odd_only:
                    keep = keep & ~(flag(f"{short}_exact") & (st != UNREADABLE))
                at = np.flatnonzero(keep)
                idx = pa.array(at)
                text = pa.array(render(us[at], st[at]), pa.string())
                yield pa.RecordBatch.from_arrays([c["table_name"].take(idx), c["record_id"].take(idx), pa.array([name]).take(pa.array(np.zeros(len(at), np.int64))), text], ["table_name", "record_id", "column_name", "utc_text"])

    return run


# --- format mixtures ---------------------------------------------------------------------

# Formats a source may write dates in; the two slash orders can read the same value.
FORMATS = ["iso", "basic", "slash_dmy", "slash_mdy", "dotted", "named", "epoch_s", "epoch_ms", "digits14", "hours"]


def slash_set(value: Column) -> Column:
    """Orders under which a slash date is valid, joined by `|`; NULL for none or no slash date."""
    a, b = (F.regexp_extract(value, r"^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}", i).try_cast("int") for i in (1, 2))
    dmy, mdy = a.between(1, 31) & b.between(1, 12), b.between(1, 31) & a.between(1, 12)
    return F.nullif(F.concat_ws("|", F.when(dmy, "slash_dmy"), F.when(mdy, "slash_mdy")), F.lit(""))


def layout_format(layout: Column) -> Column:
    """The one format of a layout without slashes; NULL for none."""
    v = layout
    return (
        F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "iso")
        .when(v.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"), "dotted")
        .when(v.rlike(r"^[0-9]{8}[Tt][0-9]{4}"), "basic")
        .when(v.rlike(r"^[0-9]{10}\z"), "epoch_s")
        .when(v.rlike(r"^[0-9]{13}\z"), "epoch_ms")
        .when(v.rlike(r"^[0-9]{14}\z"), "digits14")
        .when(v.rlike(r"^[0-9]{1,4}\z"), "hours")
        .when(v.rlike(r"[A-Za-z]{3,9}[ ,]+.*[0-9]{4}"), "named")
    )


def format_sets(values: DataFrame) -> DataFrame:
    """(cse, formats, n): values per set of formats under which they are valid, from (cse, value).

    Values are counted by layout first, so that the patterns run once per layout of a
    source; only slash dates are read value by value.
    """
    v = F.col("v")
    slash = F.contains(v, F.lit("/"))
    key = F.when(slash, slash_set(v)).when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "9999-99-99").otherwise(F.substring(F.translate(v, "012345678", "9" * 9), 1, 40))
    # Through a one-row list, so that a value is trimmed once and not in every branch.
    once = values.where("value IS NOT NULL").select("cse", F.explode(F.array(F.btrim("value", F.lit(BLANKS)))).alias("v"))
    seen = once.select("cse", slash.alias("slash"), key.alias("k")).where("k IS NOT NULL").groupBy("cse", "slash", "k").agg(F.count("*").alias("n"))
    return seen.select("cse", F.when(F.col("slash"), F.col("k")).otherwise(layout_format(F.col("k"))).alias("formats"), "n").where("formats IS NOT NULL").groupBy("cse", "formats").agg(F.sum("n").alias("n"))


def fit_mixture(counts: dict[str, int], declared: str | None = None, rounds: int = 200) -> tuple[dict[str, float], float | None]:
    """(weight of every format, posterior of day-first for a value both orders can read) of one source.

    `counts` holds values per set of valid formats. A declared order gives the other order
    no prior. The posterior is None where the data and the prior say nothing.
    """
    barred = {"DMY": "slash_mdy", "MDY": "slash_dmy"}.get(declared or "")
    sets = [([f for f in s.split("|") if f != barred], n) for s, n in counts.items() if s and n]
    used = sorted({f for fs, _ in sets for f in fs})
    w = {f: 1.0 / len(used) for f in used}
    total = sum(n for fs, n in sets if fs)
    for _ in range(rounds):
        new = dict.fromkeys(used, 0.0)
        for fs, n in sets:
            mass = sum(w[f] for f in fs)
            for f in fs:  # expectation: the value's posterior over its formats
                new[f] += n * (w[f] / mass if mass > 0 else 1 / len(fs))
        new = {f: x / total for f, x in new.items()}
        moved = max((abs(new[f] - w[f]) for f in used), default=0.0)
        w = new
        if moved < 1e-12:
            break
    if declared in ("DMY", "MDY"):
        return w, 1.0 if declared == "DMY" else 0.0
    d, m = w.get("slash_dmy", 0.0), w.get("slash_mdy", 0.0)
    return w, d / (d + m) if d + m > 0 else None


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            w, p = fit_mixture({x["formats"]: x["n"] for x in r.sets} if r.sets is not None else {}, r.declared)
            order = None if p is None else "DMY" if p >= CERTAIN else "MDY" if p <= 1 - CERTAIN else None
            rows.append((r.cse, r.tz, order, p, [w.get(f, 0.0) for f in FORMATS]))
        yield pd.DataFrame(rows, columns=["cse", "tz", "date_order", "dmy_posterior", "weights"])


def source_orders(values: DataFrame, entities: DataFrame) -> DataFrame:
    """(cse, tz, date_order, dmy_posterior, weights): one row per entity; weights are in the order of `FORMATS`.

    `values` is (cse, value). Format sets are counted per source with map-side combination;
    a source has at most a dozen sets, so the model sees one short row per entity.
    """
    ship_package(values.sparkSession)
    per = format_sets(values).groupBy("cse").agg(F.collect_list(F.struct("formats", "n")).alias("sets"))
    e = entities.where("cse_id IS NOT NULL").groupBy(F.col("cse_id").alias("cse")).agg(F.max("time_zone").alias("tz"), F.max("date_order").alias("declared"))
    return e.join(per, "cse", "left").select("cse", "tz", "declared", "sets").mapInPandas(_fit, "cse string, tz string, date_order string, dmy_posterior double, weights array<double>")


def mixture_report(values: DataFrame, entities: DataFrame) -> DataFrame:
    """(cse, format, weight, date_order, dmy_posterior) of every format a source uses."""
    o = source_orders(values, entities)
    cells = F.arrays_zip(F.array(*map(F.lit, FORMATS)).alias("format"), F.col("weights").alias("weight"))
    return o.select("cse", F.explode(cells).alias("x"), "date_order", "dmy_posterior").select("cse", F.col("x.format").alias("format"), F.round("x.weight", 6).alias("weight"), "date_order", F.round("dmy_posterior", 6).alias("dmy_posterior")).where("weight > 0")


def value_sources(rich: DataFrame, lines: DataFrame) -> DataFrame:
    """(table_name, record_id, cse, created_time, closed_time) of both tables."""
    a = rich.select(F.lit("dataset_capability_rich").alias("table_name"), F.col("row_id").cast("bigint").alias("record_id"), "cse", "created_time", "closed_time")
    b = lines.select(F.lit("test_lines").alias("table_name"), F.col("line_id").cast("bigint").alias("record_id"), "cse", "created_time", F.lit(None).cast("string").alias("closed_time"))
    return a.unionByName(b)


def written_values(rich: DataFrame, lines: DataFrame) -> DataFrame:
    """(cse, value) of the three fields."""
    return rich.select("cse", F.explode(F.array("created_time", "closed_time")).alias("value")).unionByName(lines.select("cse", F.col("created_time").alias("value")))


EXACT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def _prepared(values: DataFrame) -> DataFrame:
    """Trimmed texts, layouts, presence and exactness of both columns."""
    cols = []
    for c, short in (("created_time", "created"), ("closed_time", "closed")):
        t = F.btrim(c, F.lit(BLANKS))
        cols += [t.alias(f"{short}_text"), F.translate(t, "012345678", "9" * 9).alias(f"{short}_layout"), (t.isNotNull() & ~F.lower(t).isin(SUBMITTED_NA)).alias(f"{short}_present"), F.col(c).rlike(EXACT).alias(f"{short}_exact")]
    return values.select("table_name", "record_id", *cols, "tz", "date_order")


def _normalised(rich: DataFrame, lines: DataFrame, entities: DataFrame, odd_only: bool) -> DataFrame:
    spark = rich.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    orders = source_orders(written_values(rich, lines), entities).select("cse", "tz", "date_order").checkpoint()
    small = orders.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    j = value_sources(rich, lines).join(F.broadcast(orders) if small else orders, "cse", "left")
    return _prepared(j).mapInArrow(_normalise(odd_only), "table_name string, record_id bigint, column_name string, utc_text string")


def normalise(rich: DataFrame, lines: DataFrame, entities: DataFrame) -> DataFrame:
    """Every present value of the fields with its UTC text or reason.

    `lines` is the parsed form of test_lines without its rejected records.
    """
    return _normalised(rich, lines, entities, False)


def odd_values(rich: DataFrame, lines: DataFrame, entities: DataFrame) -> DataFrame:
    """Values not already written exactly as a valid `YYYY-MM-DDTHH:MM:SSZ`."""
    return _normalised(rich, lines, entities, True)
