"""Queries of problem 1 (languages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.language import language_report, mislabelled
from gleaner.tables import table


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "hotspot_items"), table(spark, sf_dir, "sources"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_report(spark, sf_dir)).select("item_id", "field", "seg_no", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every row, with its confidence."""
    return _report(spark, sf_dir).select("item_id", "field", "seg_no", F.col("seg_lang").alias("lang"), F.round("confidence", 4).alias("confidence"))


QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments}
SQL: dict[str, str] = {}
