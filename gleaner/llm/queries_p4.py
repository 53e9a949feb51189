"""Queries of problem 4 (new batches against history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.history import last_batch, repeated_items, repeated_papers
from gleaner.tables import shared_folder, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = repeated_items(table(spark, sf_dir, "hotspot_items"), table(spark, sf_dir, "sources"))
    papers = repeated_papers(table(spark, sf_dir, "papers"))
    return items.select(F.lit("item").alias("rec"), "key_a", "key_b").union(papers.select(F.lit("paper").alias("rec"), "key_a", "key_b"))


def p4_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated papers alone, by number."""
    return repeated_papers(table(spark, sf_dir, "papers"))


def p4_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated items of the newest batch alone, found against the stored pivot-distance table of the batches before it."""
    return last_batch(table(spark, sf_dir, "hotspot_items"), table(spark, sf_dir, "sources"), shared_folder(spark, "history"))


QUERIES = {"p4_found": p4_found, "p4_papers": p4_papers, "p4_last_batch": p4_last_batch}
SQL = {
    "p4_papers": r"""
        WITH r AS (
          SELECT paper_id AS key, batch_id AS batch, regexp_extract(arxiv_id, '(\d{4}\.\d{4,5})', 1) AS number
          FROM papers WHERE regexp_matches(arxiv_id, '\d{4}\.\d{4,5}')
        ), f AS (SELECT number, min(batch) AS b FROM r GROUP BY number),
        k AS (SELECT r.number, f.b, min(r.key) AS key_a FROM r JOIN f ON r.number = f.number AND r.batch = f.b GROUP BY r.number, f.b)
        SELECT k.key_a, r.key AS key_b FROM r JOIN k ON r.number = k.number WHERE r.batch > k.b
    """,
}
