"""Queries of problem 3 (timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import timestamps as ts
from gleaner.tables import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.digest_values(*(table(spark, sf_dir, t) for t in ("hotspot_items", "hotspot_clusters", "sources")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.normalise(_values(spark, sf_dir)).filter("status = 'ok'").select("rec", "rec_key", "instant_us")


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the texts of each kind of record resolve, by format family and status."""
    return ts.normalise(_values(spark, sf_dir)).groupBy("rec", "family", "status").agg(F.count("*").alias("n"))


def p3_source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted day/month order of each source that writes purely numeric dates."""
    return ts.fitted_orders(_values(spark, sf_dir)).select(F.col("_source").alias("source_id"), "w_dmy", "w_mdy", "w_ymd", "n")


QUERIES = {"p3_found": p3_found, "p3_status": p3_status, "p3_source_orders": p3_source_orders}
SQL: dict[str, str] = {}
