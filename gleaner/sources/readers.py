"""Readers: registries, dated daily files, XML feeds, and a Python data source with one partition per feed."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

FEED_SCHEMA = "feed string, title string, link string, summary string, published string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON registry, a list or an object that holds one under 'sites', 'sources' or 'accounts'; disabled ones out."""
    df = spark.read.option("multiLine", True).json(path)
    for name in ("sites", "sources", "accounts"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            df = df.select(F.inline(name))
            break
    return df.filter("coalesce(enabled, true)") if "enabled" in df.columns else df


def daily_files(paths: DataFrame, path: str, suffixes: list[str]) -> DataFrame:
    """``date, path``: the file of each date whose suffix comes first in ``suffixes``; other names are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    date = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-(.+)\.[a-z]+$", 1)
    suffix = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-(.+)\.[a-z]+$", 2)
    rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), suffix)
    rows = paths.withColumns({"date": F.try_to_date(date, "yyyy-MM-dd"), "_rank": rank}).filter("_rank > 0 and date is not null")
    best = F.row_number().over(Window.partitionBy("date").orderBy("_rank", path))
    return rows.withColumn("_rn", best).filter("_rn = 1").select("date", path)


def as_of(files: DataFrame, target: Column, staleness_days: int) -> DataFrame:
    """The latest file not after the target, unless it is older than allowed."""
    ok = files.filter((F.col("date") <= target) & (F.datediff(target, F.col("date")) <= staleness_days))
    return ok.agg(F.max_by(F.struct(*files.columns), "date").alias("x")).filter("x is not null").select("x.*")


def papers_of(payload: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of a daily payload, a map of papers by number or a bundle that holds one under 'papers'; ``value`` is the DDL of a paper."""
    bundle = F.from_json(column, f"papers map<string, {value}>")["papers"]
    flat = F.from_json(column, f"map<string, {value}>")
    return payload.select(F.explode(F.when(F.size(bundle) > 0, bundle).otherwise(flat)).alias("number", "paper")).select("number", "paper.*")


def feed_items(raw: DataFrame, feed: str, xml: str) -> DataFrame:
    """Entries of RSS texts, one row each; markup and entities are taken out of titles and summaries."""
    schema = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>"
    entries = raw.select(feed, F.explode(F.from_xml(xml, schema, {"rowTag": "rss"})["channel"]["item"]).alias("i"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    return entries.select(F.col(feed).alias("feed"), plain("i.title").alias("title"), F.col("i.link").alias("link"), plain(F.coalesce("i.description", F.lit(""))).alias("summary"), F.col("i.pubDate").alias("published"))


class _Feed(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeedReader(DataSourceReader):
    """One task per feed; a feed that cannot be read gives no rows instead of failing the job."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Feed(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as f:
                text = f.read()
        except OSError:
            return
        for item in re.findall(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>", text):
            part = {k: (m.group(1) if (m := re.search(rf"(?s)<{k}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{k}>", item)) else None) for k in ("title", "link", "description", "summary", "pubDate", "updated")}
            plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", html.unescape(x))).split()) if x else None
            yield (partition.path, plain(part["title"]), plain(part["link"]), plain(part["description"] or part["summary"]), plain(part["pubDate"] or part["updated"]))


class FeedSource(DataSource):
    """``spark.read.format('gleaner_feed').option('paths', 'a.xml,b.xml')`` after ``spark.dataSource.register(FeedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeedReader(self.options)
