"""Queries of problem 7 (evaluation leaks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.leaks import find_leaks, removal_spans
from gleaner.tables import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "eval_id")


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents that hold it (0 where none does)."""
    per_item = _leaks(spark, sf_dir).groupBy("eval_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "eval_items").select("eval_id", "suite").join(per_item, "eval_id", "left").select("eval_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of every document to remove, in characters, overlapping ones merged, with the items found in each."""
    return removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_leaked_items": p7_leaked_items}
SQL: dict[str, str] = {}
