from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramql.operators import timestamps as T

ALIASES = {"cet": "+01:00", "aedt": "+11:00", "eastern standard time": "America/New_York", "zulu": "UTC"}
ZONE = T.resolver(ALIASES)


def ms(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz).timestamp() * 1000)


@pytest.mark.parametrize(
    "kind, text, zone, want",
    [
        ("datetime", "2026-02-02T23:00:00+05:30", "Asia/Tokyo", ms(2026, 2, 2, 17, 30)),
        ("datetime", "2025-01-02T07:30:00+1100", "", ms(2025, 1, 1, 20, 30)),
        ("datetime", "2025-01-01T15:45:00+11", "", ms(2025, 1, 1, 4, 45)),
        ("datetime", "2025-01-01T22:08:21Z", "Europe/Vienna", ms(2025, 1, 1, 22, 8, 21)),
        ("datetime", "2025-01-06 17:15 CET", "Asia/Tokyo", ms(2025, 1, 6, 16, 15)),
        ("datetime", "2025-02-06T21:41:00 UTC", "", ms(2025, 2, 6, 21, 41)),
        ("datetime", "2025-05-30T07:00:00.839351999-0400", "", ms(2025, 5, 30, 11) + 839),
        ("datetime", "Sat, 18 Apr 2026 00:15:00 -0400", "", ms(2026, 4, 18, 4, 15)),
        ("datetime", "Apr 12, 2026 3:45 pm", "UTC", ms(2026, 4, 12, 15, 45)),
        ("datetime", "1/10/2026 12:30 AM", " utc ", ms(2026, 1, 10, 0, 30)),
        ("datetime", "18 November 2025 13:51", "eastern standard time", ms(2025, 11, 18, 18, 51)),
        ("datetime", "20260422T044500", "UTC+02:00", ms(2026, 4, 22, 2, 45)),
        ("datetime", "01.02.2025 03:30", "-08:00", ms(2025, 2, 1, 11, 30)),
        ("datetime", "2025/01/02 08:30:00", "AMERICA/new_york", ms(2025, 1, 2, 13, 30)),
        ("datetime", "1735877700000", "", 1735877700000),
        ("datetime", "1736746200", "Mars/Crater", 1736746200000),
        # twice: the earlier; skipped: on by the gap
        ("datetime", "2025-10-26T02:30:00", "Europe/Vienna", ms(2025, 10, 26, 0, 30)),
        ("datetime", "2025-03-30T02:30:00", "Europe/Vienna", ms(2025, 3, 30, 1, 30)),
        ("datetime", "2025-10-05T02:15:00", "Australia/Lord_Howe", ms(2025, 10, 4, 15, 45)),
        ("datetime", "2025-06-31 08:00", "UTC", None),
        ("datetime", "2026-13-04T09:15:00Z", "", None),
        ("datetime", "25:61", "UTC", None),
        ("datetime", "TBD", "UTC", None),
        ("datetime", "tomorrow 10am", "UTC", None),
        ("datetime", "0000-00-00", "UTC", None),
        ("datetime", "2025-01-01T10:00:00", "", None),
        ("datetime", "2025-01-01T10:00:00", "Europe/Atlantis", None),
        ("datetime", "2025-01-01T10:00:00 XYZ", "UTC", None),
        ("date", "December 11, 2025", "", ms(2025, 12, 11)),
        ("date", "20250103", "", ms(2025, 1, 3)),
        ("date", "1/14/2025", "", ms(2025, 1, 14)),
        ("date", "30.08.2025", "", ms(2025, 8, 30)),
        ("date", "2025-02-30", "", None),
    ],
)
def test_entries(kind, text, zone, want):
    assert T.parse_entry(kind, text, zone, ZONE) == want


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2035, 1, 1)), st.sampled_from(["Europe/Vienna", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kathmandu"]))
def test_local_times_follow_the_zone(local, zone):
    want = local.replace(microsecond=0, tzinfo=ZoneInfo(zone), fold=0)
    assert T.parse_entry("datetime", local.strftime("%Y-%m-%dT%H:%M:%S"), zone, ZONE) == int((want - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))


EVENTS = "raw_id bigint, account_id string, start_datetime string, start_date string, start_timezone string, zone string"


def rows(spark, events, **kw):
    e = spark.createDataFrame(events, EVENTS)
    accounts = spark.createDataFrame([("a", "Europe/Vienna"), ("b", None)], "account_id string, default_zone string")
    alias = spark.createDataFrame([("CET", "+01:00"), (None, "x"), ("Zulu", None)], "alias string, zone_name string")
    return {r.raw_id: r.start_ms for r in T.normalise_starts(e, accounts, alias, **kw).collect()}


CASES = [
    (1, "a", "2025-07-01T10:00:00", None, None, ""), (1, "a", "2025-07-01T10:00:00", None, None, ""), (2, "b", "2025-07-01T10:00:00", None, " ", ""), (3, None, " ", "2025-07-01", "x", None),
    (4, "a", None, None, None, ""), (5, "a", "2025-07-01T10:00:00", None, "nope", ""), (6, "zz", "2025-07-01 10:00 CET", None, None, ""), (7, "a", "?" * 20000, "2025-01-01", None, ""),
]


def test_normalise(spark, tmp_path):
    want = {1: ms(2025, 7, 1, 8), 3: ms(2025, 7, 1), 6: ms(2025, 7, 1, 9)}
    assert rows(spark, CASES) == want
    path = f"file://{tmp_path}/dictionary"
    assert rows(spark, CASES[:3], dictionary_path=path) == {1: want[1]}
    assert rows(spark, CASES, dictionary_path=path) == want
    entries = spark.read.parquet(path)
    assert entries.count() == entries.select("kind", "text", "zone").distinct().count()


def test_empty(spark):
    assert rows(spark, []) == {}


def test_a_changed_alias_leaves_no_stale_instant(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    e = spark.createDataFrame([(1, "a", "2025-07-01T10:00:00", None, "here", "")], EVENTS)
    accounts = spark.createDataFrame([("a", None)], "account_id string, default_zone string")
    got = [T.normalise_starts(e, accounts, spark.createDataFrame([("here", z)], "alias string, zone_name string"), path).first().start_ms for z in ("+01:00", "+02:00", "+01:00")]
    assert got == [ms(2025, 7, 1, 9), ms(2025, 7, 1, 8), ms(2025, 7, 1, 9)]
    assert spark.read.parquet(path).count() == 2
