"""Queries over every batch, with windows of the row's own, against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleaner.functions import text
from gleaner.operators import items as op
from gleaner.operators import stories as st

DATA = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


def likest(rows, back=30):
    """By key the largest likeness to a row of the ``back`` batches before."""
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    return {k: max((like(w, v) for _, c, v in rows if 1 <= b - c <= back), default=0.0) for k, b, w in rows}


def test_headline_penalty_matches_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.randrange(1, 90), rng.sample("abcdefghijklmnop", rng.randrange(0, 6))) for i in range(700)]
    want = likest([(i, b, set(w)) for i, b, w in rows])
    df = spark.createDataFrame(rows, "id long, day int, w array<string>")
    for block, pairs in ((20_000, 2_000_000), (30, 50)):
        monkeypatch.setattr(st, "BLOCK", block)
        monkeypatch.setattr(st, "PAIRS", pairs)
        got = {r["id"]: r for r in st.headline_penalty(df, "id", "day", "w").collect()}
        assert {k: round(r["likest"], 9) for k, r in got.items()} == {k: round(x, 9) for k, x in want.items()}
        assert all(abs(got[k]["factor"] - (1 - 0.3 * x if x >= 0.5 else 1.0)) < 1e-9 for k, x in want.items())


@needs_tables
def test_headline_penalty_judges_every_batch(spark):
    items = spark.read.parquet(str(DATA / "hotspot_items.parquet")).select("item_id", "batch_id", text.significant_words(F.col("title")).alias("w"))
    want = likest([(r["item_id"], r["batch_id"], set(r["w"])) for r in items.collect()])
    got = {r["item_id"]: r["likest"] for r in entry.queries()["q_headline_penalty"](spark, str(DATA)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - x) <= 0.5001e-4 for k, x in want.items())


def unseen(rows, back=30):
    """Keys of rows with an address whose address and title do not occur in the ``back`` batches before."""
    held = [{(r[i], r[1]) for r in rows if r[i] is not None} for i in (2, 3)]
    return {k for k, b, addr, title in rows if addr is not None and not any((x, b - n) in seen for x, seen in zip((addr, title), held) for n in range(1, back + 1))}


def test_not_seen_before_matches_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(1, 120), rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for i in range(400)]
    rows += [(1000, 1, 900, 900), (1001, 31, 900, 901), (1002, 62, 900, 902), (1003, 62, 900, 903), (1004, 63, 904, 902)]
    df = spark.createDataFrame(rows, "id long, day int, addr int, title int")
    got = op.not_seen_before(df, "day", ["addr", "title"], 30).filter("addr is not null")
    assert sorted(r["id"] for r in got.collect()) == sorted(unseen(rows))


@needs_tables
def test_crossday_antijoin_takes_every_batch(spark):
    items = spark.read.parquet(str(DATA / "hotspot_items.parquet")).select("item_id", "batch_id", "canonical_url", "url", "title").collect()
    # a blank address is none: the plain one stands in for it
    want = unseen([(i, b, (canonical or "").strip(" ") or (url or "").strip(" ") or None, title) for i, b, canonical, url, title in items])
    assert sorted(r["item_id"] for r in entry.queries()["q_crossday_antijoin"](spark, str(DATA)).collect()) == sorted(want)


def test_capped_sections_per_group(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(5), i, rng.choice("abcdef"), rng.randrange(9)) for i in range(300)] + [(9, 1000, "f", 1)]
    want = set()
    for day in {r[0] for r in rows}:
        placed = []
        for family in "abcdef":
            own = sorted((r for r in rows if r[0] == day and r[2] == family), key=lambda r: (-r[3], r[1]))[:6]
            placed += [(day, family, r[1], place) for place, r in enumerate(own, 1)]
        want |= set(placed[:25])
    df = spark.createDataFrame(rows, "day int, id long, family string, score int")
    got = st.capped_sections(df, ["day"], "family", [F.desc("score"), F.asc("id")], 6, 25, F.col("family")).select("day", "family", "id", "place")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@needs_tables
def test_sections_of_every_batch(spark):
    batches = {r[0] for r in spark.read.parquet(str(DATA / "hotspot_items.parquet")).select("batch_id").distinct().collect()}
    got = entry.queries()["q_sections"](spark, str(DATA)).collect()
    assert {r["batch_id"] for r in got} == batches
    assert len({r["item_id"] for r in got}) == len(got) and max(r["place"] for r in got) <= 6


def test_raw_limit_is_per_batch(spark, tmp_path):
    # the limit goes before the gate: of 250 rows a batch 240 are looked at, of which one in five has a title too short
    rows = [(1000 * b + i, b, "s", "short" if i % 5 == 0 else f"A title that is long enough, number {i} of them all") for b in (1, 2, 3) for i in range(250)]
    spark.createDataFrame(rows, "item_id long, batch_id int, source_id string, title string").write.parquet(str(tmp_path / "hotspot_items.parquet"))
    got = entry.queries()["q_raw_limit_then_gate"](spark, str(tmp_path)).collect()
    assert sorted(r["item_id"] for r in got) == [1000 * b + i for b in (1, 2, 3) for i in range(240) if i % 5]
