"""Queries of problem 2 (near-duplicates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.neardup import all_pairs, near_classes
from gleaner.operators.components import connected_components
from gleaner.tables import cut_lineage, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*near_classes(table(spark, sf_dir, "hotspot_items")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item that has a near-duplicate or copy, residue left out: the group it belongs to and the number of classes linked to its own."""
    members, pairs = near_classes(table(spark, sf_dir, "hotspot_items"))
    pairs = cut_lineage(pairs)
    labels = connected_components(pairs)
    links = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "d")
    rows = members.join(labels.withColumnRenamed("vertex", "d"), "d", "left").join(links, "d", "left")
    rows = rows.withColumn("component", F.coalesce("component", "d")).withColumn("links", F.coalesce("links", F.lit(0)))
    size = rows.groupBy("component").agg(F.count("*").alias("group_size"), F.min("item_id").alias("group_id")).filter("group_size > 1")
    return rows.join(size, "component").select("item_id", "group_id", "group_size", "links")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
