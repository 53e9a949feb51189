"""Readers and sinks on files in a temporary folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleaner.plans import scorer as sc
from gleaner.sources import html, readers, sinks

RSS = "<rss><channel><item><title>One &amp; two</title><link>https://x.example/1</link><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Sat, 11 Oct 2025 03:49:03 +0200</pubDate></item><item><title>Three</title></item></channel></rss>"


def test_feed_source(spark, tmp_path):
    good = tmp_path / "a.xml"
    good.write_text(RSS)
    spark.dataSource.register(readers.FeedSource)
    rows = spark.read.format("gleaner_feed").option("paths", f"{good},{tmp_path}/missing.xml").load().collect()
    assert [(r["title"], r["summary"]) for r in rows] == [("One & two", "Text"), ("Three", None)]


def test_feed_items_by_expression(spark):
    got = readers.feed_items(spark.createDataFrame([("f", RSS)], "feed string, xml string"), "feed", "xml").collect()
    assert [(r["title"], r["published"]) for r in got] == [("One & two", "Sat, 11 Oct 2025 03:49:03 +0200"), ("Three", None)]


def test_registry_and_daily_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"sites": [{"id": "a", "enabled": True}, {"id": "b", "enabled": False}, {"id": "c"}]}))
    assert sorted(r["id"] for r in readers.registry(spark, str(tmp_path / "r.json")).collect()) == ["a", "c"]
    names = ["2026-03-18-output.json", "2026-03-20-latest.json", "2026-03-20-output.json", "2026-03-21-daily.json", "x.json", "2026-99-99-output.json"]
    files = readers.daily_files(spark.createDataFrame([(f"/p/{n}",) for n in names], "path string"), "path", ["output", "daily", "latest"])
    assert sorted(r["path"] for r in files.collect()) == ["/p/2026-03-18-output.json", "/p/2026-03-20-output.json", "/p/2026-03-21-daily.json"]
    assert readers.as_of(files, F.lit("2026-03-20").cast("date"), 2).first()["path"] == "/p/2026-03-20-output.json"
    assert readers.as_of(files, F.lit("2026-04-20").cast("date"), 2).count() == 0


def test_papers_of_both_shapes(spark):
    flat, bundle = json.dumps({"1": {"title": "a"}}), json.dumps({"schema_version": 2, "papers": {"2": {"title": "b"}}})
    got = readers.papers_of(spark.createDataFrame([(flat,), (bundle,)], "j string"), "j", "struct<title: string>")
    assert {("1", "a"), ("2", "b")} <= {tuple(r) for r in got.collect()}


def test_html_rows(spark):
    spark.udtf.register("rows_of", html.ArticleRows)
    ld = '<script type="application/ld+json">{"headline": "H", "url": "u", "datePublished": "2026-01-01"}</script>'
    art = '<article><a href="/x"><h3>Card &amp; title</h3></a><time datetime="2026-02-02">Feb</time><p>Body</p></article>'
    plain = '<a href="/n">Nav</a><a href="/y">A link of four words</a>'
    spark.createDataFrame([(1, ld), (2, art), (3, plain), (4, None), (5, "")], "id int, page string").createOrReplaceTempView("pages_t")
    got = {(r["id"], r["title"], r["link"], r["published"], r["origin"]) for r in spark.sql("SELECT id, r.* FROM pages_t, LATERAL rows_of(page) r").collect()}
    assert got == {(1, "H", "u", "2026-01-01", "json-ld"), (2, "Card & title", "/x", "2026-02-02", "article"), (3, "A link of four words", "/y", None, "anchor")}
    best = spark.createDataFrame([(plain + '<a href="/z">four words</a>',)], "p string").select(html.best_anchor(html.anchors(F.col("p")), F.array(F.lit("four"), F.lit("words"))).alias("b"))
    assert best.first()["b"] == "/z"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = spark.createDataFrame([(i, "t1") for i in range(10)], "k int, at string")
    assert sinks.write_snapshot(a, path, ["at"]) == "written"
    assert sinks.write_snapshot(a.withColumn("at", F.lit("t2")), path, ["at"]) == "unchanged"
    assert sinks.write_snapshot(a.limit(2), path, ["at"]) == "guarded"
    assert sinks.write_snapshot(a.filter("k < 8"), path, ["at"]) == "written"
    assert spark.read.parquet(path).count() == 8


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write_partitions(spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int"), path, ["day"], "parquet")
    sinks.write_partitions(spark.createDataFrame([("d2", 5)], "day string, n int"), path, ["day"], "parquet")
    assert {(r["day"], r["n"]) for r in spark.read.parquet(path).collect()} == {("d1", 1), ("d2", 5)}


def test_scorer_retries_and_falls_back(spark):
    import pandas as pd

    def flaky(pdf):
        if (pdf["k"] == 3).any():
            raise ValueError
        return pd.DataFrame({"k": pdf["k"], "v": 1})

    def fallback(pdf):
        return pd.DataFrame({"k": pdf["k"], "v": 0})

    got = sc.with_fallback(spark.range(8).withColumnRenamed("id", "k"), "k", flaky, fallback, "k long, v long", size=1)
    assert {r["k"]: (r["v"], r["by"]) for r in got.collect()} == {k: (0, "fallback") if k == 3 else (1, "scorer") for k in range(8)}
