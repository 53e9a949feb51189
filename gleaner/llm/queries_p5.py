"""Queries of problem 5 (residue)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.residue import find_residue
from gleaner.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "hotspot_items"))


def p5_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and left out by source once residue is excluded."""
    items = table(spark, sf_dir, "hotspot_items")
    bad = find_residue(items).select("item_id").distinct().withColumn("bad", F.lit(1))
    return (
        items.select("item_id", "source_id").join(bad, "item_id", "left").groupBy("source_id")
        .agg(F.count_if(F.col("bad").isNull()).alias("kept"), F.count_if(F.col("bad").isNotNull()).alias("left_out"))
    )


QUERIES = {"p5_found": p5_found, "p5_clean_counts": p5_clean_counts}
SQL: dict[str, str] = {}
