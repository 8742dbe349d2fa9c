"""Problem 5 against datetime and zoneinfo, one value at a time."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayledger.functions.shapes import NONE, instants_ms
from wayledger.functions.zones import zone_tables
from wayledger.operators.instants import EPOCH_MS, ISO_Z, known_zones, unusual_instants

ZONES = ["Europe/London", "America/New_York", "UTC"]
TABLES = zone_tables(ZONES)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def ms(t):
    return (t.astimezone(UTC) - EPOCH) // timedelta(milliseconds=1)


def one(value, zone="Europe/London", day_first=True):
    got = int(instants_ms([value], [zone], [day_first], TABLES)[0])
    return None if got == NONE else got


@given(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), st.sampled_from(ZONES))
@settings(max_examples=300, deadline=None)
def test_local_times_of_every_form(t, zone):
    t = t.replace(microsecond=0)
    want = ms(t.replace(tzinfo=ZoneInfo(zone), fold=0))
    for text, first in (
        (t.strftime("%Y-%m-%dT%H:%M:%S"), True),
        (t.strftime("%Y%m%dT%H%M%S"), True),
        (t.strftime("%d/%m/%Y %H:%M:%S"), True),
        (t.strftime("%m/%d/%Y %H:%M:%S"), False),
        (t.strftime("%d %b %Y %H:%M:%S"), True),
        (t.strftime("%B %d, %Y %H:%M:%S"), True),
    ):
        assert one(text, zone, first) == want, text


@given(st.datetimes(datetime(1990, 1, 1), datetime(2060, 1, 1)), st.integers(-12, 12))
@settings(max_examples=200, deadline=None)
def test_named_offsets(t, hours):
    t = t.replace(microsecond=t.microsecond // 1000 * 1000)
    want = (t - timedelta(hours=hours) - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
    sign = f"{hours:+03d}"
    assert one(t.strftime("%Y-%m-%dT%H:%M:%S.%f") + f"{sign}:00") == want
    assert one(t.strftime("%Y-%m-%d %H:%M:%S.%f") + f"{sign}00") == want
    whole = want - want % 1000
    assert one(t.strftime("%a, %d %b %Y %H:%M:%S ") + f"{sign}00") == whole
    assert one(t.strftime("%Y-%m-%d %H:%M:%S ") + f"GMT{sign}:00") == whole


def test_daylight_saving():
    assert one("2025-10-26T01:30:00") == ms(datetime(2025, 10, 26, 0, 30, tzinfo=UTC))  # twice: the first
    assert one("2025-03-30T01:30:00") == ms(datetime(2025, 3, 30, 1, 30, tzinfo=UTC))  # skipped: moved on
    assert one("2025-07-01") == ms(datetime(2025, 6, 30, 23, 0, tzinfo=UTC))
    assert one("11/2/2025 1:30 AM", "America/New_York", False) == ms(datetime(2025, 11, 2, 5, 30, tzinfo=UTC))


def test_epochs_and_abbreviations():
    assert one("1736543797") == 1736543797000
    assert one("1736543797591.0") == 1736543797591
    assert one("1736543797591999") == 1736543797591
    assert one("/Date(1736543797591-0500)/") == 1736543797591
    assert one("12 Jan 2025 06:58:35 UTC") == ms(datetime(2025, 1, 12, 6, 58, 35, tzinfo=UTC))
    assert one("01 Jul 2025 01:00:00 BST") == ms(datetime(2025, 7, 1, 0, 0, tzinfo=UTC))
    assert one("11 Jan 2025, 11.17") == ms(datetime(2025, 1, 11, 11, 17, tzinfo=UTC))
    assert one("12/1/2025 12:05 AM") == ms(datetime(2025, 1, 12, 0, 5, tzinfo=UTC))


@pytest.mark.parametrize("junk", ["", " ", "0", "-", "TBC", "n/a", "null", "to be confirmed", "2025-02-30", "31/31/2025 10:00:00", "2025-01-01T25:00:00", "12 Foo 2025 10:00:00 UTC", "12 Jan 2025 10:00:00 QQQ", "é" * 10, "9" * 500, "13:00 PM", "0000000000"])
def test_no_instant(junk):
    assert one(junk) is None


def test_query_edges(spark):
    rows = [(1, "a", "2025-07-01T10:00:00"), (2, None, "2025-07-01T10:00:00"), (3, "gone", "2025-07-01T10:00:00"), (4, "a", None), (5, "a", "1736543797591"), (1, "a", "2025-07-01T10:00:00")]
    df = spark.createDataFrame(rows, "k long, feed string, v string").selectExpr("k", "feed", "v", "'x' as value", "'y' as field_name", "1 as case")
    feeds = spark.createDataFrame([("a", "Europe/London", True), ("a", "Europe/London", True)], "feed string, zone_name string, day_first boolean")
    got = sorted((r.row_key, r.utc_ms) for r in unusual_instants(df, feeds, "k", {"v": EPOCH_MS}, src_table="t").collect())
    nine, ten = ms(datetime(2025, 7, 1, 9, tzinfo=UTC)), ms(datetime(2025, 7, 1, 10, tzinfo=UTC))
    assert got == [(1, nine), (1, nine), (2, ten), (3, ten)]
    assert unusual_instants(df.limit(0), feeds.limit(0), "k", {"v": ISO_Z}).count() == 0


def test_zone_tables(spark, small):
    from wayledger.plans.general import p5_forms, p5_zones

    zones = p5_zones(spark, small).collect()
    assert {r.zone_name for r in zones} == set(ZONES) and all(r.tz_version for r in zones)
    assert any(r.from_utc_s == ms(datetime(2025, 3, 30, 1, tzinfo=UTC)) // 1000 and r.offset_s == 3600 for r in zones)
    assert all(r.none >= 0 and r.usual > r.other_form > 0 for r in p5_forms(spark, small).collect())


def test_zones_of_very_many_feeds(spark):
    names = [f"No/Zone{i}" for i in range(6000)] + ZONES
    feeds = spark.createDataFrame([(f"f{i}", n, True) for i, n in enumerate(names)], "feed string, zone_name string, day_first boolean")
    assert set(known_zones(feeds)) == set(ZONES)


@pytest.mark.parametrize("zone", ["Europe/London", "America/New_York"])
def test_any_year(zone):
    """Years before, amid and after the zone data's own, against zoneinfo."""
    rng = random.Random(zone)
    cases = [datetime(1943, 7, 1, 12), datetime(2150, 7, 1, 12), datetime(1700, 1, 1), datetime(9999, 7, 1), datetime(2500, 3, 28, 1, 30), datetime(2100, 12, 31, 23)]
    cases += [datetime(rng.randrange(1500, 9999), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), 30) for _ in range(300)]
    for t in cases:
        assert one(t.isoformat(), zone) == ms(t.replace(tzinfo=ZoneInfo(zone), fold=0)), t


def test_any_number_of_decimals():
    want = ms(datetime(2025, 1, 12, 6, 58, 35, 123000, tzinfo=UTC))
    assert one("2025-01-12T06:58:35." + "123" + "4" * 60 + "Z") == want
    assert one("Sunday, 12 January 2025 06:58:35,123" + "9" * 90 + " GMT+00:00") == want
    assert one("2025-01-12T06:58:35" + " " * 60 + "junk") is None
