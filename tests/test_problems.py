"""Problems 2, 3, 4, 6 and 7 against hand-made cases and plain Python."""

import csv
import datetime as dt
import io
import json
import random
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.operators import drift, orphans, parsing, quality, timestamps
from auditlake.plans import submissions

# --- problem 2 -------------------------------------------------------------------------

RICH = "row_id bigint, feed_id bigint, load_no int, host string, closed_by string, telemetry_available string, n bigint, value string"


def loads(spark, *loads_):
    rows, i = [], 0
    for no, values in enumerate(loads_, 1):
        for v in values:
            i += 1
            rows.append((i, 1, no, v, "ann.a", "True", 7, "clash"))
    return spark.createDataFrame(rows, RICH)


def found(df):
    return {tuple(r) for r in quality.load_changes(df, submissions.WATCHED, submissions.STATED).collect()}


def test_null_rate_limit_is_included(spark):
    df = loads(spark, ["AB-01"] * 20, ["AB-01"] * 17 + ["n/a", " ", None])
    assert (1, 2, "host", "null_rate") in found(df)
    assert (1, 2, "host", "null_rate") not in found(loads(spark, ["AB-01"] * 20, ["AB-01"] * 18 + [None, "--"]))


def test_pattern_distinct_and_shares(spark):
    a = ["AB-01", "AB-02", "AB-03", "AB-04"] * 5
    assert found(loads(spark, a, a)) == set()
    assert (1, 2, "host", "pattern") in found(loads(spark, a, a[:17] + ["ab-01", "AB-1", "AB-01 "]))
    assert (1, 2, "host", "distinct") in found(loads(spark, a, ["AB-01"] * 20))
    assert (1, 2, "host", "distinct") not in found(loads(spark, a, ["AB-01", "AB-02"] * 10))
    assert (1, 2, "host", "shares") in found(loads(spark, a, ["AB-01", "AB-02"] * 10))


def test_loads_without_predecessor_or_values(spark):
    df = loads(spark, ["AB-01"] * 4, [None] * 4, ["AB-01"] * 4)
    f = found(df)
    assert {x for x in f if x[2] == "host"} == {(1, 2, "host", "null_rate"), (1, 3, "host", "null_rate")}
    assert found(df.where("load_no <> 2")) == set()
    assert found(df.limit(0)) == set()
    assert quality.mask_report(df.limit(0), ["host"]).count() == 0
    assert found(df.withColumn("feed_id", F.lit(None).cast("bigint"))) == set()


def test_mask_report(spark):
    r = quality.mask_report(loads(spark, ["AB-01"] * 9 + ["ab-01"], ["AB-01"] * 5 + ["ab-01"] * 5), ["host"], rare=0.2).orderBy("load_no").collect()
    assert (r[0].top_mask, r[0].rare_mask_rows, r[0].divergence) == ("A-9", 1, None)
    assert 0 < r[1].divergence < 1


def test_ranges_and_masks_of_whole_texts(spark):
    same = "seen again " * 9
    df = loads(spark, [same + x for x in ("b", "a", "c7", "b")], [same + "B", same + "z"])
    for r in (quality.mask_report(df, ["host"]), quality.wide_profile(df.select("feed_id", "load_no", "host"))):
        first, second = sorted(r.collect(), key=lambda x: x.load_no)
        assert (first.min_value, first.max_value, first.n_distinct) == (same + "a", same + "c7", 3)
        assert (second.min_value, second.max_value, second.n_off_form) == (same + "B", same + "z", 1)


def test_wide_profile_has_every_column(spark):
    df = loads(spark, ["AB-01"] * 3)
    assert {r.column_name for r in quality.wide_profile(df).collect()} == set(df.columns) - {"feed_id", "load_no"}


def test_profile_covers_every_column(spark, tmp_path):
    rows = [(1, load, f"{v}", "x") for load, vs in enumerate([[10, 9, 100] * 40 + ["x-1"], ["a-1", "b-2", "c-3"] * 40], 1) for v in vs]
    df = spark.createDataFrame(rows, "feed_id bigint, load_no int, priority string, host string")
    df.write.parquet(str(tmp_path / "dataset_capability_rich.parquet"))
    r = {(x.load_no, x.column_name): x for x in submissions.p2_profile(spark, str(tmp_path)).collect()}
    assert set(r) == {(load, c) for load in (1, 2) for c in ("priority", "host")}
    assert (r[1, "priority"].n_rare_masks, r[1, "priority"].rare_mask_rows) == (1, 1)
    assert [(x.load_no, x.mask, x.n) for x in quality.Loads(df, ["priority"]).rare(0.02).collect()] == [(1, "a-9", 1)]
    assert r[1, "priority"].changes == "" and r[2, "priority"].changes == "pattern,shares" and r[2, "host"].changes == ""
    w = {x.load_no: x for x in quality.wide_profile(df.where("priority <> 'x-1'")).collect() if x.column_name == "priority"}
    assert (w[1].n_distinct, w[1].min_value, w[1].max_value) == (3, "9", "100") and w[2].max_value == "c-3"


# --- problem 3 -------------------------------------------------------------------------


def one(text, zone="Europe/Berlin", order="DMY", closed=None):
    s = lambda x: pd.Series([x], dtype=object)
    us, st = timestamps.parse_values(s(text), s(zone), s(order))
    if closed is None:
        return timestamps.render(us, st)[0]
    us, st = timestamps.parse_values(s(closed), s(zone), s(order), (us, st, pd.notna(s(text)).to_numpy()))
    return timestamps.render(us, st)[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-07-01T12:00:00Z", "2026-07-01T12:00:00.000000Z"),
        ("2026-07-01t12:00:00z", "2026-07-01T12:00:00.000000Z"),
        ("  2026-07-01 12:00 ", "2026-07-01T10:00:00.000000Z"),
        ("2026-01-01", "2025-12-31T23:00:00.000000Z"),
        ("2026-07-01T12:00:00.1234567+02:00", "2026-07-01T10:00:00.123456Z"),
        ("2026-07-01T12:00:00-0430", "2026-07-01T16:30:00.000000Z"),
        ("2026-07-01T12:00:00+02", "2026-07-01T10:00:00.000000Z"),
        ("2025-10-26T02:30:00+02:00[Europe/Berlin]", "2025-10-26T00:30:00.000000Z"),
        ("2025-10-26 02:30:00 CET", "2025-10-26T01:30:00.000000Z"),
        ("2025-10-26 02:30:00 CEST", "2025-10-26T00:30:00.000000Z"),
        ("2025-10-26 02:30:00", "ambiguous"),
        ("2026-03-29 02:30:00", "nonexistent"),
        ("03/04/2026", "2026-04-02T22:00:00.000000Z"),
        ("03.04.2026 05:06", "2026-04-03T03:06:00.000000Z"),
        ("31/04/2026 00:00:00", "unreadable"),
        ("00/00/0000", "unreadable"),
        ("3 Feb 2026, 04:51", "2026-02-03T03:51:00.000000Z"),
        ("August 30, 2026 1:59 pm", "2026-08-30T11:59:00.000000Z"),
        ("August 30, 2026 12:10 am", "2026-08-29T22:10:00.000000Z"),
        ("01/02/2026 12:30 AM", "2026-01-31T23:30:00.000000Z"),
        ("01/02/2026 13:30 PM", "unreadable"),
        ("Fri, 01 May 2026 00:07:36 +1000", "2026-04-30T14:07:36.000000Z"),
        ("1759280138", "2025-10-01T00:55:38.000000Z"),
        ("1759280138123", "2025-10-01T00:55:38.123000Z"),
        ("20260715152508", "2026-07-15T13:25:08.000000Z"),
        ("20260715T152508Z", "2026-07-15T15:25:08.000000Z"),
        ("202601", "unreadable"), ("12:30", "unreadable"), ("week 9", "unreadable"), ("17", "unreadable"), ("2026-02-29", "unreadable"), ("2026-01-01 27:71", "unreadable"), ("٢٠٢٦-01-01", "unreadable"), ("x" * 100_000, "unreadable"),
    ],
)
def test_notations(text, want):
    assert one(text) == want


def test_order_zone_and_hours():
    assert one("03/04/2026", order="MDY") == "2026-03-03T23:00:00.000000Z"
    assert one("13/04/2026", order="MDY") == "unreadable"
    assert one("13/04/2026", order=None) == "2026-04-12T22:00:00.000000Z"
    assert one("03/04/2026", order=None) == "ambiguous"
    assert one("2026-07-01 12:00", zone=None) == "unreadable"
    assert one("2026-07-01 12:00", zone="No/Where") == "unreadable"
    assert one("2026-07-01T12:00:00Z", closed="36") == "2026-07-03T00:00:00.000000Z"
    assert one("week 9", closed="36") == "unreadable"
    assert one("2025-10-26 02:30:00", closed="36") == "ambiguous"


def test_local_times_against_the_zone_database():
    rng = random.Random(5)
    for zone in ("Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kathmandu"):
        z = ZoneInfo(zone)
        for _ in range(200):
            t = dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randrange(525_600 * 2))
            a, b = t.replace(tzinfo=z, fold=0).astimezone(dt.UTC), t.replace(tzinfo=z, fold=1).astimezone(dt.UTC)
            want = a.strftime("%Y-%m-%dT%H:%M:%S.000000Z") if a == b else "ambiguous" if a < b else "nonexistent"
            assert one(t.strftime("%Y-%m-%d %H:%M"), zone) == want


def test_mixture_decides_undeclared_order(spark):
    ent = spark.createDataFrame([("A", "Etc/UTC", None), ("B", "Etc/UTC", "MDY"), ("C", "Etc/UTC", None)], "cse_id string, time_zone string, date_order string")
    v = spark.createDataFrame([("A", "13/01/2026")] * 9 + [("A", "02/03/2026")] * 9 + [("B", "25/12/2025")] + [("C", "02/03/2026")], "cse string, value string")
    got = {r.cse: r.date_order for r in timestamps.source_orders(v, ent).collect()}
    assert got == {"A": "DMY", "B": "MDY", "C": None}


def test_mixture_over_all_formats():
    w, p = timestamps.fit_mixture({"slash_dmy": 40, "slash_dmy|slash_mdy": 50, "slash_mdy": 10, "iso": 100})
    assert w["iso"] == pytest.approx(0.5) and p == pytest.approx(0.8) and sum(w.values()) == pytest.approx(1)
    assert timestamps.fit_mixture({"slash_dmy": 40, "slash_dmy|slash_mdy": 50, "iso": 1})[1] == pytest.approx(1)
    assert timestamps.fit_mixture({"slash_dmy|slash_mdy": 50})[1] == pytest.approx(0.5)
    w, p = timestamps.fit_mixture({"slash_dmy|slash_mdy": 50, "slash_dmy": 9}, "MDY")
    assert p == 0.0 and w["slash_mdy"] == pytest.approx(1)
    assert timestamps.fit_mixture({}) == ({}, None)


def test_hidden_orders_are_recovered(spark):
    """The declared orders are taken away; the mixture finds them again from unambiguous days."""
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(12):
        want[f"E{i}"] = "DMY" if i % 2 else "MDY"
        for _ in range(60):
            d, m = rng.randint(1, 28), rng.randint(1, 12)
            rows.append((f"E{i}", f"{d:02d}/{m:02d}/2026" if i % 2 else f"{m:02d}/{d:02d}/2026"))
    ent = spark.createDataFrame([(e, "Etc/UTC", None) for e in want], "cse_id string, time_zone string, date_order string")
    v = spark.createDataFrame(rows, "cse string, value string")
    assert {r.cse: r.date_order for r in timestamps.source_orders(v, ent).collect()} == want
    rep = timestamps.mixture_report(v, ent).where("cse = 'E1'").collect()
    assert max(rep, key=lambda r: r.weight).format == "slash_dmy"


def test_normalise_tables(spark):
    rich = spark.createDataFrame([(1, "E", "2026-07-01T12:00:00Z", "5", "x"), (2, None, "2026-07-01 12:00", None, "x"), (3, "E", "n/a", "5", "x"), (4, "E", None, None, None)], "row_id bigint, cse string, created_time string, closed_time string, tz string")
    lines = spark.createDataFrame([(9, "E", "01/02/2026")], "line_id bigint, cse string, created_time string")
    ent = spark.createDataFrame([("E", "Europe/Berlin", "DMY")], "cse_id string, time_zone string, date_order string")
    got = {tuple(r) for r in timestamps.odd_values(rich, lines, ent).collect()}
    t = "dataset_capability_rich"
    assert got == {(t, 1, "closed_time", "2026-07-01T17:00:00.000000Z"), (t, 2, "created_time", "unreadable"), (t, 3, "closed_time", "unreadable"), ("test_lines", 9, "created_time", "2026-01-31T23:00:00.000000Z")}
    assert timestamps.odd_values(rich.limit(0), lines.limit(0), ent.limit(0)).count() == 0


# --- problem 4 -------------------------------------------------------------------------


def stream(spark, *files):
    f = spark.createDataFrame([(i, 1, i, "fam", "E") for i in range(1, len(files) + 1)], "file_id bigint, stream_id bigint, seq_no int, family string, cse string")
    r = [(i, k, json.dumps(o) if not isinstance(o, str) else o) for i, rows in enumerate(files, 1) for k, o in enumerate(rows)]
    return f, spark.createDataFrame(r, "file_id bigint, record_no int, record string")


def drifted(spark, *files):
    return {tuple(r) for r in drift.changes(*stream(spark, *files)).collect()}


def rec(n=6, **over):
    out = []
    for i in range(n):
        r = {"severity": ["LOW", "HIGH"][i % 2], "host": f"DB-{i:02d}", "notes": f"the host number {i} was looked at again", "created": f"2026-01-0{i + 1}T00:00:00Z", "zone": ["dmz", "core"][i % 2]}
        for k, v in over.items():
            (r.pop(k, None) if v is None else r.__setitem__(k, v(i) if callable(v) else v))
        out.append(r)
    return out


def test_renames_follow_content(spark):
    got = drifted(spark, rec(), rec(severity=None, prio=lambda i: ["LOW", "HIGH"][i % 2]), rec(severity=None, prio=None, Prio=lambda i: ["LOW", "HIGH"][i % 2], host=None, asset=lambda i: f"WEB-{i:02d}"))
    assert got == {(2, "renamed", "severity", "prio"), (3, "renamed", "prio", "Prio"), (3, "renamed", "host", "asset")}


def test_unlike_fields_are_removed_and_added(spark):
    got = drifted(spark, rec(), rec(zone=None, department=lambda i: ["Legal", "Plant"][i % 2]))
    assert got == {(2, "removed", "zone", ""), (2, "added", "", "department")}
    got = drifted(spark, rec(a=lambda i: i + 20), rec(b=lambda i: i + 26_000))
    assert got == {(2, "removed", "a", ""), (2, "added", "", "b")}


def test_retyped_and_nulls(spark):
    assert drifted(spark, rec(), rec(host=lambda i: {"name": f"DB-{i:02d}"})) == {(2, "retyped", "host", "host")}
    assert drifted(spark, rec(), rec(host=lambda i: None if i else "DB-01")) == set()
    assert drifted(spark, rec(x=None), [{**r, "x": None} for r in rec()]) == {(2, "added", "", "x")}
    assert drifted(spark, rec(), [*rec(), "not json", "[1]"]) == set()
    assert drifted(spark, rec(), []) == {(2, "removed", c, "") for c in rec()[0]}


def test_consistent_table_uses_first_names(spark):
    f, r = stream(spark, rec(2), rec(2, host=None, asset=lambda i: f"WEB-{i:02d}"), rec(2, host=None, asset=None, Asset=lambda i: f"WEB-{i:02d}"))
    t = drift.consistent_table(f, r).collect()
    assert len(t) == 6 and all(set(x.fields) == {"severity", "host", "notes", "created", "zone"} for x in t)
    assert {x.field: x.names for x in drift.union_schema(f, r).collect()} == {**{n: [n] for n in ("severity", "notes", "created", "zone")}, "host": ["Asset", "asset", "host"]}


def test_consistent_table_keeps_types_fields_and_records(spark):
    host = lambda i: f"WEB-{i:02d}"
    f, r = stream(spark, rec(2, mins=5), rec(2, mins=6, host=None, asset=host), [*rec(2, mins=7, host=lambda i: {"k": i}, asset=host), {}])
    t = drift.consistent_table(f, r).select("file_id", "record_no", F.to_json("fields", {"ignoreNullFields": "false"}).alias("j")).collect()
    got = {(x.file_id, x.record_no): json.loads(x.j) for x in t}
    assert len(t) == len(got) == 7 and {type(v["mins"]) for v in got.values() if v["mins"] is not None} == {int}
    assert sum(all(v is None for v in x.values()) for x in got.values()) == 1
    last = [x for (i, _), x in got.items() if i == 3 and x["mins"]]
    assert all(x["host"].startswith("WEB-") and set(x["host~3"]) == {"k"} for x in last) and len(last) == 2


def test_types_fold_through_the_lattice(spark):
    v = iter([1, 2.5, True, "x", {"a": 1}, [1], None, 3, 4, 5, 6, 7])
    f, r = stream(spark, [{"whole": 1, "num": 1, "mixed": 1, "flag": True, "box": {"a": 1}, "none": None}, {"whole": 2, "num": 0.5, "mixed": "x", "flag": False, "box": {"a": 2}}], [{"whole": 7, "num": 2, "mixed": next(v), "flag": True, "box": {"a": 3}, "none": None}])
    got = {x.field: x.union_type for x in drift.union_schema(f, r).collect()}
    assert got == {"whole": "whole", "num": "number", "mixed": "string", "flag": "boolean", "box": "object", "none": None}
    assert {(x.name, x.type) for x in drift.file_headers(r).where("file_id = 1").collect()} >= {("mixed", "string"), ("num", "number"), ("none", None)}
    t = {(x.file_id, x.record_no): json.loads(x.j) for x in drift.consistent_table(f, r).select("file_id", "record_no", F.to_json("fields", {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert t[1, 0]["mixed"] == "1" and t[1, 1]["mixed"] == "x" and t[2, 0]["whole"] == 7 and t[1, 0]["box"] == {"a": 1} and t[1, 0]["num"] == 1.0


def test_log_is_ordered_and_second_best_pairs_are_found(spark):
    lab = lambda *x: (lambda i: x[i % len(x)])
    f, r = stream(spark, rec(a=lab("red", "blue"), b=lab("red", "blue", "green")), rec(c=lab("red", "blue"), d=lab("red", "green", "blue")))
    log = drift.Drift(f, r).log.orderBy("stream_id", "seq_no", "change_no").collect()
    assert [(x.change_no, x.change) for x in log] == [(1, "renamed"), (2, "renamed")] and {x.old_name for x in log} == {"a", "b"}


def test_a_name_added_anew_is_not_the_field_it_was(spark):
    host = lambda i: f"WEB-{i:02d}"
    f, r = stream(spark, rec(2), rec(2, host=None, asset=host), rec(2, host=None), rec(2, host=None, asset=lambda i: f"a longer remark about item {i} here"))
    got = {(x.file_id, x.name): x.field for x in drift.Drift(f, r).names.collect()}
    assert got[2, "asset"] == "host" and got[4, "asset"] == "asset"


def test_drift_of_empty_tables(spark):
    f, r = stream(spark, rec())
    assert drift.changes(f.limit(0), r.limit(0)).count() == 0
    assert drift.changes(f.withColumn("stream_id", F.lit(None).cast("bigint")), r).count() == 0


# --- problem 6 -------------------------------------------------------------------------

HEAD = "alert_id,priority,host,created_time,closed_time,closed_by,investigation_notes,random_field,department"


def judge(spark, *lines, head=HEAD):
    rows = [(1, "E", 1, 1, head)] + [(i, "E", 1, i, x) for i, x in enumerate(lines, 2)]
    df = spark.createDataFrame(rows, "line_id bigint, cse string, file_no bigint, line_no int, raw_line string")
    return {r.line_id - 2: r.reason for r in parsing.rejected(df).collect()}


def plain_reason(line):
    """The rules read character by character."""
    s = line[:-1] if line.endswith("\r") else line
    out, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            j, val = i + 1, ""
            while True:
                if j >= len(s):
                    return "quoting"
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        val += '"'
                        j += 2
                        continue
                    break
                val += s[j]
                j += 1
            if j + 1 < len(s) and s[j + 1] != ",":
                return "quoting"
            out.append(val)
            i = j + 1
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return "quoting"
            out.append(s[i:j])
            i = j
        if i >= len(s):
            break
        i += 1
        if i == len(s):
            out.append("")
            break
    if len(out) != 9:
        return "column_count"
    a, c = out[0].strip(" "), out[4].strip(" ")
    if not (a[:4] == "TST-" and len(a) == 13 and a[4:].isascii() and a[4:].isdigit()):
        return "alert_id"
    if c and not (c.isascii() and c.isdigit() and int(c) <= 525600):
        return "closed_time"
    return None


def test_lines_against_a_character_reader(spark):
    rng = random.Random(3)
    good = ["TST-000000001", "HIGH", "DB-01", "2026", "10", "ann.a", "some, \"text\"\nhere", "x", "Legal"]
    cases = ["", ",", '"', "a" * 100_000, '"' + '""' * 20_000 + '"', ",".join(good[:2]), ",,,,,,,,", 'TST-000000001,a"b"c,,,1,,,,', 'TST-000000001,"a"b,,,1,,,,', ' "TST-000000001",,,,1,,,,', "TST-000000001,,,, 1 ,,,,\r", "TST-00000000१,,,,1,,,,", "TST-000000001,,,,525601,,,,", "TST-000000001,,,,0525600,,,,", "TST-000000001,,,,1.0,,,,", "TST-000000001,,,,,,,,x\\\"", "TST-000000001,,,,99999999999999999999,,,,", 'TST-000000001,"",,,1,"""",,,', "tst-000000001,,,,1,,,,"]
    for _ in range(300):
        buf = io.StringIO()
        csv.writer(buf, lineterminator="").writerow(good)
        s = list(buf.getvalue())
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(['"', ",", "", "x", '""', " ", "\r"])
        cases.append("".join(s))
    got = judge(spark, *cases)
    for i, c in enumerate(cases):
        assert got.get(i) == plain_reason(c), repr(c[:200])


def test_header_order_nulls_and_empty(spark):
    other = "priority,alert_id,host,created_time,closed_by,closed_time,investigation_notes,random_field,department"
    assert judge(spark, "HIGH,TST-000000001,,,,5,,,", "TST-000000001,HIGH,,,,5,,,", "HIGH,TST-000000001,,,5,x,,,", None, head=other) == {1: "alert_id", 2: "closed_time", 3: "column_count"}
    df = spark.createDataFrame([], "line_id bigint, cse string, file_no bigint, line_no int, raw_line string")
    assert parsing.rejected(df).count() == 0 and parsing.loaded(df).count() == 0


def test_loaded_values(spark):
    df = spark.createDataFrame([(1, "E", 1, 1, HEAD), (2, "E", 1, 2, ' TST-000000001 ,"HIGH",DB-01,,7,,"a ""b"", c",,x', )], "line_id bigint, cse string, file_no bigint, line_no int, raw_line string")
    r = parsing.loaded(df).first()
    assert (r.alert_id, r.priority, r.closed_minutes, r.investigation_notes) == ("TST-000000001", "HIGH", 7, 'a "b", c')


# --- problem 7 -------------------------------------------------------------------------


def test_references_against_brute_force(spark):
    rng = random.Random(9)
    t0 = dt.datetime(2026, 1, 1)
    at = lambda: t0 + dt.timedelta(hours=rng.randrange(50))
    keys = [f"A-{i}" for i in range(30)]
    target = [(rng.choice(keys), at(), at() if rng.random() < 0.5 else None, "x") for _ in range(80)]
    refs = [(i, rng.choice(["P1", None]), rng.choice([*keys, "hot", "hot", "hot", " a-3 ", "a-4", "Z-1", None, "n/a", " - "]), at(), 1) for i in range(600)]
    target += [("HOT", t0 + dt.timedelta(hours=10), None, "x")]
    rdf = spark.createDataFrame(refs, "row_id bigint, period string, alert_id string, received_at timestamp_ntz, n int")
    tdf = spark.createDataFrame(target, "alert_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string")
    got = {r.row_id: r.reason for r in orphans.orphans({"t": rdf}, tdf).collect()}
    for i, _, k, when, _ in refs:
        k = None if k is None or k.strip().lower() in ("n/a", "-") else k.strip().upper()
        if k is None:
            assert i not in got
            continue
        own = [x for x in target if x[0].upper() == k]
        here = [x for x in own if x[1] <= when]
        want = "missing" if not own else "late" if not here else "deleted" if all(x[2] is not None and x[2] <= when for x in here) else None
        assert got.get(i) == want, (i, k, when)
    rep = orphans.orphan_report({"t": rdf}, tdf).collect()
    assert sum(r.orphans for r in rep) == len(got)
    assert {r.reason for r in orphans.orphans({"t": rdf}, tdf.limit(0)).collect()} == {"missing"}
    assert orphans.orphans({"t": rdf.limit(0)}, tdf).count() == 0


def test_hot_references_take_the_broadcast_path(spark):
    t0 = dt.datetime(2026, 1, 1)
    day = lambda n: t0 + dt.timedelta(days=n)
    refs = [(i, "P", "hot" if i % 3 == 0 else "held" if i % 3 == 1 else f"k{i}", day(i % 5)) for i in range(600)]
    rdf = spark.createDataFrame(refs, "row_id bigint, period string, alert_id string, received_at timestamp_ntz")
    tdf = spark.createDataFrame([("HOT", day(2), None), ("HELD", day(0), None)], "alert_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    for parts in (4, 1_000_000):
        r = orphans.References({"t": rdf}, tdf, parts)
        assert r.heavy == (2 if parts == 4 else 202)
        want = {(i, "late" if k == "hot" else "missing") for i, _, k, at in refs if (k == "hot" and at < day(2)) or k[0] == "k"}
        assert {(x.row_id, x.reason) for x in r.orphans().collect()} == want
        assert {(x.reason, x.orphans, x.checked_references) for x in r.report().collect()} == {("late", sum(w == "late" for _, w in want), 600), ("missing", 200, 600)}
    r = orphans.References({"t": rdf}, tdf, 4)
    assert "BroadcastHashJoin" in r.orphans()._jdf.queryExecution().toString()
