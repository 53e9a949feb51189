"""Operators behind the views: rollups, neighbours, search, quality metrics, scenario simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.num import half_up, share


def calendar_rollup(days: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """Sums by day, month, year and in all, with the grouping level (0 day, 1 month, 3 year, 7 all)."""
    parts = days.withColumns({"year": F.year(day), "month": F.date_format(day, "yyyy-MM"), "day": F.col(day).cast("date")})
    return parts.rollup("year", "month", "day").agg(F.grouping_id().cast("int").alias("level"), *[F.sum(m).alias(m) for m in measures], F.count("*").alias("rows"))


def neighbours(days: DataFrame, day: str) -> DataFrame:
    """Each day with the one before and after that exists; days are few, one row each."""
    w = Window.orderBy(day)
    return days.select(day).distinct().select(day, F.lag(day).over(w).alias("previous"), F.lead(day).over(w).alias("next"))


def search(rows: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows that hold the query somewhere, whatever the case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.lower())))


def entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """The entropy in bits of the shares within each group."""
    total = F.sum(n).over(Window.partitionBy(*group))
    p = F.col(n) / total
    return counts.filter(F.col(n) > 0).withColumn("_p", p).groupBy(*group).agg(half_up(-F.sum(F.col("_p") * F.log2("_p")), 6).alias("entropy"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The upper median per group, from counts by value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    cum = F.sum("c").over(Window.partitionBy(*group).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(*group))
    return counts.withColumns({"_cum": cum, "_total": total}).filter(F.col("_cum") > F.floor(F.col("_total") / 2)).groupBy(*group).agg(F.min(value).alias("median"))


def gate_scenarios(rows: DataFrame, scenarios: list[tuple[str, int, int, bool]], ts: Column, target: Column, group: str) -> DataFrame:
    """Rows that pass, by scenario (name, hours back, hours ahead, unknown times pass), in one pass over the rows."""
    passes = [
        F.struct(F.lit(name).alias("scenario"), F.coalesce((ts >= target - F.expr(f"INTERVAL '{back}' HOUR")) & (ts <= target + F.expr(f"INTERVAL '{ahead}' HOUR")), F.lit(unknown)).alias("ok"))
        for name, back, ahead, unknown in scenarios
    ]
    return rows.select(group, F.explode(F.array(*passes)).alias("s")).groupBy("s.scenario", group).agg(F.count_if("s.ok").alias("kept"), F.count("*").alias("seen"))


def quality_gate(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check, passed`` for every check over a row of metrics, and 'all'."""
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()])).alias("x")).select("x.*")
    return rows.unionByName(rows.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check"), "passed"))


__all__ = ["calendar_rollup", "neighbours", "search", "entropy", "upper_median", "gate_scenarios", "quality_gate", "share"]
