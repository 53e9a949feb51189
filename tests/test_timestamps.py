"""Timestamps: every form against an instant worked out by hand, clock changes, and the per-source order."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from gleaner.operators import timestamps as ts

SCHEMA = "_key long, _source string, _home string, _near_us long, _text string"


def us(*parts: int, frac: int = 0) -> int:
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + frac


CASES = [
    ("2025-10-10T21:08:12Z", "UTC", us(2025, 10, 10, 21, 8, 12)),
    ("2025-10-11T08:25:45", "America/Los_Angeles", us(2025, 10, 11, 15, 25, 45)),
    ("2025-10-11T15:08:25+02:00", "UTC", us(2025, 10, 11, 13, 8, 25)),
    ("2025-10-11T23:12:36+0800", "UTC", us(2025, 10, 11, 15, 12, 36)),
    ("2025-10-11 03:26", "Asia/Kolkata", us(2025, 10, 10, 21, 56)),
    ("  2025-10-11   03:26 ", "UTC", us(2025, 10, 11, 3, 26)),
    ("2025-10-11", "Asia/Tokyo", us(2025, 10, 10, 15)),
    ("2025-10-11T10:35:34.327Z", "UTC", us(2025, 10, 11, 10, 35, 34, frac=327000)),
    ("2025-10-11T00:16:17.659772+00:00", "UTC", us(2025, 10, 11, 0, 16, 17, frac=659772)),
    ("2025-10-11T08:40:37,456+09:00", "UTC", us(2025, 10, 10, 23, 40, 37, frac=456000)),
    ("20251010T213914Z", "UTC", us(2025, 10, 10, 21, 39, 14)),
    ("1760225207", "Asia/Tokyo", 1760225207000000), ("1760225207691", "UTC", 1760225207691000), ("1760158387102604", "UTC", 1760158387102604),
    ("2025-W41-7T09:59:22+08:00", "UTC", us(2025, 10, 12, 1, 59, 22)),
    ("Sat, 11 Oct 2025 03:49:03 +0200", "UTC", us(2025, 10, 11, 1, 49, 3)),
    ("Fri, 10 Oct 2025 23:34:03 GMT", "Asia/Tokyo", us(2025, 10, 10, 23, 34, 3)),
    ("Mon, 3 Nov 2025 05:14:17 CET", "UTC", us(2025, 11, 3, 4, 14, 17)),
    ("Mon Oct  6 19:25:57 UTC 2025", "Asia/Tokyo", us(2025, 10, 6, 19, 25, 57)),
    ("Nov 12, 2025 at 2:00 PM PST", "America/Los_Angeles", us(2025, 11, 12, 22)),
    ("December 11, 2025 12:10 am ET", "UTC", us(2025, 12, 11, 5, 10)),
    ("October 12, 2025", "UTC", us(2025, 10, 12)),
    ("10 janvier 2026 à 20h16", "Europe/Paris", us(2026, 1, 10, 19, 16)),
    ("11. März 2026, 22:13 Uhr", "Europe/Berlin", us(2026, 3, 11, 21, 13)),
    ("10 de marzo de 2026, 23:05 h", "Europe/Madrid", us(2026, 3, 10, 22, 5)),
    ("14 октября 2025 г., 13:24", "Europe/Moscow", us(2025, 10, 14, 10, 24)),
    ("2026年1月10日 00:10", "Asia/Shanghai", us(2026, 1, 9, 16, 10)),
    ("2025-10-12T04:49:45-07:00[America/Los_Angeles]", "UTC", us(2025, 10, 12, 11, 49, 45)),
    ("2025-10-08T05:47:47[America/New_York]", "UTC", us(2025, 10, 8, 9, 47, 47)),
    ("2025-12-10 20:20:50 CST", "America/Chicago", us(2025, 12, 11, 2, 20, 50)),
    ("2025-12-10 20:20:50 CST", "Asia/Shanghai", us(2025, 12, 10, 12, 20, 50)),
    ("2025-11-02 02:21:44 EST", "America/New_York", us(2025, 11, 2, 7, 21, 44)),
    ("2025-10-25 00:13:53 IST", "Asia/Kolkata", us(2025, 10, 24, 18, 43, 53)),
    # clock changes: once, never, twice; an offset or abbreviation settles it
    ("2026-03-08T02:30:00", "America/New_York", "gap"),
    ("2025-11-02T01:30:00", "America/New_York", "overlap"),
    ("2025-11-02T01:30:00-05:00", "America/New_York", us(2025, 11, 2, 6, 30)),
    ("2025-11-02 01:30:00 EDT", "America/New_York", us(2025, 11, 2, 5, 30)),
    ("2025-11-02T01:30:00[America/New_York]", "UTC", "overlap"),
    # nothing
    (None, "UTC", "null"), ("", "UTC", "null"), ("  ", "UTC", "null"), ("Invalid Date", "UTC", "unparsed"), ("0000-00-00T00:00:00Z", "UTC", "unparsed"),
    ("2026-02-30", "UTC", "unparsed"), ("2025-10-11T25:00:00Z", "UTC", "unparsed"), ("yesterday", "UTC", "relative"), ("3 hours ago", "UTC", "relative"),
    ("2025-10-11T08:00:00", None, "unknown_zone"), ("2025-10-11 08:00:00 XYZ", "UTC", "unknown_zone"), ("x" * 20_000, "UTC", "unparsed"),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, "s", home, None, text) for i, (text, home, _) in enumerate(CASES)]
    return {r["_key"]: r for r in ts.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{str(c[0])[:30]}|{c[1]}" for c in CASES])
def test_case(results, i):
    want = CASES[i][2]
    got = results[i]
    assert (got["instant_us"] if isinstance(want, int) else got["status"]) == want, got


def test_order_is_learnt_by_source(spark):
    day_first = [(i, "eu", "UTC", None, f"{d:02d}/01/2026 10:00") for i, d in enumerate(range(1, 29))]
    month_first = [(100 + i, "us", "UTC", None, f"01/{d:02d}/2026 10:00") for i, d in enumerate(range(1, 29))]
    stray = [(200, "us", "UTC", None, "25/01/2026 10:00"), (201, "alone", "UTC", None, "03/04/2026 10:00"), (202, "alone2", "UTC", None, "05/05/2026 10:00"), (203, "eu", "UTC", None, "13/13/2026 10:00")]
    got = {r["_key"]: r for r in ts.normalise(spark.createDataFrame(day_first + month_first + stray, SCHEMA)).collect()}
    assert got[2]["instant_us"] == us(2026, 1, 3, 10) and got[2]["chosen_order"] == "dmy"
    assert got[102]["instant_us"] == us(2026, 1, 3, 10) and got[102]["chosen_order"] == "mdy"
    assert got[200]["status"] == "unparsed"  # a date that this source's order does not allow
    assert got[201]["status"] == "ambiguous"  # a source that leaves it open
    assert got[202]["instant_us"] == us(2026, 5, 5, 10)  # either order names the same day
    assert got[203]["status"] == "unparsed"


def test_empty_and_further_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", status string, family string").drop("status", "family")
    assert ts.normalise(empty).count() == 0
    twice = spark.createDataFrame([(1, "s", "UTC", None, "2026-01-01")] * 2, SCHEMA)
    assert ts.normalise(twice).count() == 2


def test_nulls_in_the_tables(spark):
    items = spark.createDataFrame([(1, None, None, None), (None, "a", None, "2026-01-01")], "item_id long, source_id string, fetched_at timestamp, published_at string")
    clusters = spark.createDataFrame([("c", None, "2026-01-01"), ("d", [], None)], "cluster_id string, cluster_items array<struct<item_id:long,source_id:string,title:string>>, published_at string")
    sources = spark.createDataFrame([("a", "UTC"), ("b", None), ("z", "No/Where")], "source_id string, home_zone string")
    got = {(r["rec"], r["rec_key"]): r["status"] for r in ts.normalise(ts.digest_values(items, clusters, sources)).collect()}
    assert got == {("item", "1"): "null", ("item", None): "ok", ("cluster", "c"): "unknown_zone", ("cluster", "d"): "null"}
