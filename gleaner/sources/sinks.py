"""Sinks: dated partitions replaced one by one, idempotent snapshots, rendered lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str], fmt: str = "json") -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def same_rows(a: DataFrame, b: DataFrame, ignoring: list[str]) -> bool:
    """Do two tables hold the same rows, repeats included, but for some columns?"""
    a, b = a.drop(*ignoring), b.drop(*ignoring)
    return sorted(a.columns) == sorted(b.columns) and not a.exceptAll(b.select(a.columns)).limit(1).count() and not b.select(a.columns).exceptAll(a).limit(1).count()


def write_snapshot(df: DataFrame, path: str, ignoring: list[str], least_share: float = 0.5) -> str:
    """Write a snapshot unless it equals the one there ('unchanged') or lost more than allowed of its rows ('guarded')."""
    spark: SparkSession = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no snapshot yet
        df.write.parquet(path)
        return "written"
    if same_rows(df, old, ignoring):
        return "unchanged"
    if df.count() < least_share * old.count():
        return "guarded"
    spare = path.rstrip("/") + ".next"
    df.write.mode("overwrite").parquet(spare)
    spark.read.parquet(spare).write.mode("overwrite").parquet(path)
    return "written"


def markdown_list(df: DataFrame, group: str, order: list[str], title: str, link: str) -> DataFrame:
    """``group, body``: a rendered list per group, lines in order."""
    line = F.concat(F.lit("- ["), F.regexp_replace(F.coalesce(title, F.lit("")), r"[\[\]]", ""), F.lit("]("), F.coalesce(link, F.lit("")), F.lit(")"))
    rows = df.select(group, F.struct(*order, line.alias("line")).alias("x"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))


def linked_days(days: DataFrame, date: str = "date", first: str | None = None) -> DataFrame:
    """Day documents with the dates before and after that exist; days before ``first`` are not supported and go.

    A day is one row, so the neighbours are found over the dates alone and joined back.
    """
    from gleaner.operators.views import neighbours

    kept = days.filter(F.col(date) >= F.lit(first).cast("date")) if first else days
    return kept.join(F.broadcast(neighbours(kept, date)), date)  # one row a day


def write_days(days: DataFrame, path: str, measures: list[str], date: str = "date", first: str | None = None) -> None:
    """Write day documents and all that depends on the set of days.

    The days given are merged over those that are there, days before ``first`` are dropped, the neighbours of every day are
    linked anew, and the indexes (all, by month, by year) are rebuilt; months and years without a day leave no index.
    Layout: ``days/date=...``, ``index/level=root|month|year``.
    """
    from gleaner.operators.views import calendar_rollup
    from gleaner.tables import cut_lineage

    spark = days.sparkSession
    days = days.drop("previous", "next")
    try:
        old = spark.read.json(f"{path}/days", schema=days.schema).drop("previous", "next")
        days = days.unionByName(old.join(days.select(date).distinct(), date, "left_anti"))
    except AnalysisException:
        pass  # nothing is there yet
    linked = cut_lineage(linked_days(days, date, first))
    linked.write.mode("overwrite").partitionBy(date).json(f"{path}/days")
    sums = calendar_rollup(linked, date, measures)
    level = F.when(F.col("level") == 1, "month").when(F.col("level") == 3, "year").when(F.col("level") == 7, "root")
    index = sums.withColumn("level", level).filter("level is not null")
    index.drop("day").write.mode("overwrite").partitionBy("level").json(f"{path}/index")


def write_daily_papers(papers: DataFrame, path: str, date: str = "date", number: str = "number", topic: str = "topic") -> None:
    """The daily papers in both shapes: ``output`` (a map by number) and ``daily-papers`` (a bundle with sections in order of size).

    ``papers``: one row a paper and day, at most a day's papers a document.
    """
    fields = [c for c in papers.columns if c != date]
    paper = F.struct(*fields)
    flat = papers.groupBy(date).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), paper.alias("v"))))).alias("papers"))
    ids = papers.filter(F.col(topic).isNotNull()).groupBy(date, topic).agg(F.array_sort(F.collect_list(number)).alias("paper_ids"))
    sections = ids.groupBy(date).agg(F.array_sort(F.collect_list(F.struct((-F.size("paper_ids")).alias("n"), F.col(topic).alias("kind"), "paper_ids"))).alias("s"))
    bundle = flat.join(sections, date, "left").select(date, F.to_json(F.struct(F.lit(2).alias("schema_version"), "papers", F.transform(F.coalesce("s", F.array()), lambda x: F.struct(x["kind"].alias("kind"), x["paper_ids"].alias("paper_ids"))).alias("sections"))).alias("value"))
    for kind, df in (("output", flat.select(date, F.to_json("papers").alias("value"))), ("daily-papers", bundle)):
        df.withColumn("kind", F.lit(kind)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date, "kind").text(path)


def monthly_summary(rows: DataFrame, order: list[str]) -> DataFrame:
    """Generated monthly rows that are to be kept (unmarked ones are), numbered per month by ``order`` descending, then number."""
    kept = rows.filter(F.coalesce("KEEP_IN_MONTHLY", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("month").orderBy(*[F.desc_nulls_last(c) for c in order], "number"))
    return kept.withColumn("place", place)
