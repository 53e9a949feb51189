"""Operators of the paper flow: topic assignment, diagnostics, two-stage selection, monthly digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.tables import fixed_rows


def keyword_topics(rows: DataFrame, key: str, fields: dict[str, int], topics: DataFrame, topic: str, keywords: str, default: str, least: int = 1) -> DataFrame:
    """``key, topic, score``: the topic with most keyword points (a field's weight per keyword it holds), ties by topic order.

    ``topics`` is a small dimension; it is turned into one expression, so rows are scored where they lie.
    """
    dims = [(r[0], list(r[1])) for r in sorted(fixed_rows(topics.select(topic, keywords), 1000, "topics"))]
    scores = []
    for i, (name, words) in enumerate(dims):
        points: Column = F.lit(0)
        for field, weight in fields.items():
            low = F.lower(F.coalesce(F.col(field), F.lit("")))
            for w in words:
                points = points + F.when(F.contains(low, F.lit(w)), weight).otherwise(0)
        scores.append(F.struct(points.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return rows.select(key, F.when(best["score"] >= least, best["name"]).otherwise(F.lit(default)).alias("topic"), best["score"].alias("score"))


def two_stage_pick(rows: DataFrame, group: str, first: tuple[Column, list[Column], int], second: tuple[Column, list[Column], int], key: str) -> DataFrame:
    """``group, key, kind, place``: the best by the first rule, then by the second among those not yet chosen."""

    def best(df: DataFrame, rule: tuple[Column, list[Column], int], kind: str) -> DataFrame:
        condition, order, n = rule
        w = Window.partitionBy(group).orderBy(*order)
        return df.filter(condition).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(group, key, F.lit(kind).alias("kind"), "place")

    a = best(rows, first, "first")
    return a.unionByName(best(rows.join(a.select(key), key, "left_anti"), second, "second"))


def monthly_best(rows: DataFrame, month: Column, key: str, order: list[Column]) -> DataFrame:
    """One row per month and key, the first in ``order``."""
    w = Window.partitionBy("month", key).orderBy(*order)
    return rows.withColumn("month", month).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def digest_caps(rows: DataFrame, topic: str, order: list[Column], per_topic: int, total: int) -> DataFrame:
    """Per month at most ``per_topic`` rows of a topic and ``total`` in all; each topic's best stays in any case."""
    by_topic = Window.partitionBy("month", topic).orderBy(*order)
    kept = rows.withColumn("in_topic", F.row_number().over(by_topic)).filter(F.col("in_topic") <= per_topic)
    month = Window.partitionBy("month")
    first = F.count_if(F.col("in_topic") == 1).over(month)
    rest = F.row_number().over(Window.partitionBy("month", F.col("in_topic") == 1).orderBy(*order))
    return kept.withColumns({"_first": first, "_rest": rest}).filter((F.col("in_topic") == 1) | (F.col("_rest") <= total - F.col("_first"))).drop("_first", "_rest")


def content_hash(rows: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """``group, n, hash``: a hash of a group's rows that any change alters and no reordering does.

    Rows are hashed one by one, their keys included, and the digests added up in four parts of 60 bits: sums combine map-side
    and do not depend on order, so no group is gathered in one place.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in (order, *fields)]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    sums = F.concat_ws("-", *[part(i).cast("decimal(38,0)").cast("string") for i in range(4)])
    return rows.select(group, row.alias("_h")).groupBy(group).agg(F.count("*").alias("n"), F.sha2(sums, 256).alias("hash"))
