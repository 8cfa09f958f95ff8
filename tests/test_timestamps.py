"""The stamp operator against an independent reading with datetime and zoneinfo, and on defined edge cases."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
import pytest

from thermaline.operators import timestamps
from thermaline.operators.timestamps import ABBREVIATIONS, normalise_stamps

DATA = "/root/testdata/sf0.01"
ZONES = {z.lower(): z for z in available_timezones()}
MON = {m: i % 12 + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())} | {"mär": 3, "mai": 5, "okt": 10, "dez": 12}
EPOCH = datetime(1970, 1, 1)


def us(d):
    return (d - EPOCH) // timedelta(microseconds=1)


def offset(z):
    z = z.upper()
    if z in ABBREVIATIONS:
        return ABBREVIATIONS[z]
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d\d)?", z)
    return m and (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)


def brute(raw, zone, order):
    if raw is None:
        return None
    s, zone = raw.strip(" \t\r\n\"'"), (zone or "").strip(" \t\r\n\"'")
    if m := re.fullmatch(r"(\d+) (milliseconds|seconds) since (\d{4}-\d\d-\d\d)[ T]00:00:00 ?(?:UTC|Z)", s, re.I):
        return us(datetime.combine(date.fromisoformat(m[3]), datetime.min.time())) + int(m[1]) * (1000 if m[2] == "milliseconds" else 1_000_000)
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", s):
        return int(s) * 10 ** {10: 6, 13: 3, 16: 0}[len(s)]
    own, half = "", ""
    clock = r"(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?\s*(AM|PM)?\s*([A-Z]{1,5}|[+-]\d\d:?(?:\d\d)?)?"
    if m := re.fullmatch(r"(\d\d)(\d{10})", s):
        y, mo, d, h, mi, sec, f = 2000 + int(m[1]), *(int(m[2][k : k + 2]) for k in range(0, 10, 2)), ""
    elif m := re.fullmatch(r"(\d{8})[_T]?(\d{6})[.]?(\d{3})?(Z)?", s, re.I):
        t = m[1] + m[2]
        y, mo, d, h, mi, sec, f, own = int(t[:4]), *(int(t[k : k + 2]) for k in range(4, 14, 2)), m[3] or "", m[4] or ""
    else:
        if m := re.fullmatch(r"(\d{4})-(\d{3})T" + clock, s, re.I):
            try:
                day = date(int(m[1]), 1, 1) + timedelta(int(m[2]) - 1)
            except ValueError:
                return None
            y, mo, d, rest = day.year, day.month, day.day, m.groups()[2:]
        elif m := re.fullmatch(r"(\d{4})[-/](\d\d)[-/](\d\d)[ T]" + clock, s, re.I):
            y, mo, d, rest = int(m[1]), int(m[2]), int(m[3]), m.groups()[3:]
        elif m := re.fullmatch(r"(\d{1,2})\.?[- ]([^\W\d]{3})[- ](\d{4}) " + clock, s, re.I):
            y, mo, d, rest = int(m[3]), MON[m[2].lower()], int(m[1]), m.groups()[3:]
        elif m := re.fullmatch(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}) " + clock, s, re.I):
            y, mo, d, rest = int(m[3]), int(m[2]), int(m[1]), m.groups()[3:]
            if order == "mdy":
                mo, d = d, mo
        else:
            return None
        h, mi, sec, f, half, own = int(rest[0]), int(rest[1]), int(rest[2]), rest[3] or "", (rest[4] or "").upper(), rest[5] or ""
    if half:
        h = h % 12 + 12 * (half == "PM")
    try:
        wall = datetime(y, mo, d, h, mi, sec, int((f + "000000")[:6]))
    except ValueError:
        return None
    if own:
        return us(wall) - offset(own) * 60_000_000
    if zone.lower() in ZONES:
        found = set()
        for fold in (0, 1):
            t = wall.replace(tzinfo=ZoneInfo(ZONES[zone.lower()]), fold=fold).astimezone(timezone.utc)
            if t.astimezone(ZoneInfo(ZONES[zone.lower()])).replace(tzinfo=None) == wall:
                found.add(us(t.replace(tzinfo=None)))
        return found.pop() if len(found) == 1 else None
    o = offset(zone)
    return None if o is None else us(wall) - o * 60_000_000


def test_whole_table_against_brute_force(spark):
    rec, inst = spark.read.parquet(f"{DATA}/recordings.parquet"), spark.read.parquet(f"{DATA}/instruments.parquet")
    got = normalise_stamps(rec, "file_id", "device_id", {"filename_tstamp": "timezone_input_files", "netcdf_time": "timezone_netcdf"}, "arrived_at", inst.select("device_id", "date_order"))
    got = {(r.row_id, r.field): r.utc_us for r in got.collect()}
    want = {}
    for r in rec.join(inst.select("device_id", "date_order"), "device_id", "left").collect():
        want[r.file_id, "filename_tstamp"] = brute(r.filename_tstamp, r.timezone_input_files, r.date_order)
        want[r.file_id, "netcdf_time"] = brute(r.netcdf_time, r.timezone_netcdf, r.date_order)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert len(got) == len(want)


CASES = [
    ("2022-03-27 02:30:00", "Europe/Amsterdam", None, "skipped"),
    ("2022-10-30 02:30:00", "Europe/Amsterdam", None, "repeated"),
    ("2022-10-30 02:30:00 CEST", "Europe/Amsterdam", "2022-10-30T00:30:00", "ok"),
    ("2022-04-03 01:45:00", "Australia/Lord_Howe", None, "repeated"),
    ("2022-02-30 02:30:00", "UTC", None, "impossible"),
    ("2022-02-28 24:30:00", "UTC", None, "impossible"),
    ("2024-02-29 23:59:59.1234569", "utc", "2024-02-29T23:59:59.123456", "ok"),
    ("2024-366T00:00:00", "UTC", "2024-12-31T00:00:00", "ok"),
    ("2023-366T00:00:00", "UTC", None, "impossible"),
    ("2022-01-01 12:00:00", "UTC+2", "2022-01-01T10:00:00", "ok"),
    ("2022-01-01 12:00:00", "GMT-3", "2022-01-01T15:00:00", "ok"),
    ("2022-01-01 12:00:00", "etc/gmt-9", "2022-01-01T03:00:00", "ok"),
    ("2022-01-01 12:00:00", "local", None, "no_zone"),
    ("2022-01-01 12:00:00", None, None, "no_zone"),
    ("2022-01-01T12:00:00-03:30", None, "2022-01-01T15:30:00", "ok"),
    ("86400 seconds since 2000-01-01 00:00:00 UTC", "Asia/Tokyo", "2000-01-02T00:00:00", "ok"),
    ("1.5 hours since 2000-01-01", None, "2000-01-01T01:30:00", "ok"),
    ("12/31/2022 12:00:01 am", "UTC", "2022-12-31T00:00:01", "ok"),
    ("'1. mär 2022 12:00:00'", " Utc\t", "2022-03-01T12:00:00", "ok"),
    ("2022-01-01", "UTC", None, "unreadable"),
    ("", "UTC", None, "missing"),
    (None, "UTC", None, "missing"),
    ("x" * 100_000, "UTC", None, "unreadable"),
]


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, None, s, z, "clash") for i, (s, z, _, _) in enumerate(CASES)] * 2, "id long, dev string, s string, z string, row_id string")
    got = {r.row_id: r for r in normalise_stamps(df, "id", "dev", {"s": "z"}).collect()}
    for i, (s, z, want, status) in enumerate(CASES):
        assert (got[i].utc_us, got[i].status) == (want and us(datetime.fromisoformat(want)), status), (s, z, got[i])
    assert len(got) == len(CASES)


def test_mixture_learns_a_source_and_marks_what_stays_open(spark):
    stamps = [("a", f"{d:02}/03/2022 01:00:00") for d in range(13, 29)] + [("a", "05/03/2022 01:00:00")] + [("b", "05/03/2022 01:00:00")]
    df = spark.createDataFrame([(i, d, s, "UTC") for i, (d, s) in enumerate(stamps)], "id long, dev string, s string, z string")
    got = {r.row_id: r for r in normalise_stamps(df, "id", "dev", {"s": "z"}, sure=0.9).collect()}
    assert got[16].utc_us == us(datetime(2022, 3, 5, 1)) and got[16].status == "ok"
    assert got[17].status == "ambiguous" and got[17].utc_us is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, dev string, s string, z string")
    assert normalise_stamps(df, "id", "dev", {"s": "z"}).count() == 0


def numeric(spark, stamps, order=None):
    """Status and day of 'a-b-2024 10:00:00' stamps of one source that arrived on 2024-05-06."""
    rows = spark.createDataFrame([(i, "s", t, "UTC", datetime(2024, 5, 6)) for i, t in enumerate(stamps)], "id long, src string, stamp string, zone string, arrived timestamp")
    orders = spark.createDataFrame([("s", order)], "src string, o string") if order else None
    got = normalise_stamps(rows, "id", "src", {"stamp": "zone"}, "arrived", orders).collect()
    return {r.row_id: (r.status, datetime.fromtimestamp(r.utc_us / 1e6, timezone.utc).strftime("%m-%d") if r.utc_us is not None else None) for r in got}


def test_a_declared_order_is_a_strong_but_finite_prior(spark, monkeypatch):
    stamps = ["06-05-2024 10:00:00"] + ["05-06-2024 10:00:00"] * 40
    assert set(numeric(spark, stamps, "dmy").values()) == {("ok", "05-06"), ("ok", "06-05")}
    assert numeric(spark, stamps, "dmy")[1] == ("ok", "06-05")  # though May is when it arrived
    monkeypatch.setattr(timestamps, "DECLARED", 3.0)
    monkeypatch.setattr(timestamps, "BROKEN", 0.0)
    assert numeric(spark, stamps, "dmy")[1] == ("ok", "05-06")  # enough stamps outweigh a weak one


def test_what_the_declared_order_cannot_read_is_broken_and_not_of_another_order(spark):
    stamps = ["25-13-2024 10:00:00", "05-25-2024 10:00:00", "25-05-2024 10:00:00"]
    assert numeric(spark, stamps, "dmy") == {0: ("impossible", None), 1: ("impossible", None), 2: ("ok", "05-25")}
    assert numeric(spark, stamps)[1] == ("ok", "05-25") and numeric(spark, stamps)[0][0] == "impossible"


def test_without_a_declared_order_the_mixture_decides_or_leaves_it_open(spark):
    clear = ["25-04-2024 10:00:00"] * 30
    assert numeric(spark, [*clear, "04-05-2024 10:00:00"])[30] == ("ok", "05-04")
    assert numeric(spark, ["05-05-2024 10:00:00"])[0] == ("ok", "05-05")
    assert numeric(spark, ["07-05-2024 10:00:00", "05-07-2024 10:00:00"])[0][0] in ("ok", "ambiguous")


def test_no_stamp_matches_two_formats(spark):
    from pyspark.sql import functions as F

    from thermaline.operators.timestamps import FORMATS, _clean

    rows = spark.read.parquet("/root/testdata/sf0.01/recordings.parquet")
    stamps = rows.select(_clean(F.col("filename_tstamp")).alias("s")).union(rows.select(_clean(F.col("netcdf_time"))))
    several = sum((F.col("s").rlike(rx).cast("int") for _, rx, _ in FORMATS.values()), F.lit(0))
    assert stamps.filter(several > 1).count() == 0
