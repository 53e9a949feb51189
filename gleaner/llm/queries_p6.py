"""Queries of problem 6 (packing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.packing import pack, token_counts
from gleaner.tables import table


#: The vocabulary file, unless the session names another in ``spark.gleaner.vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (of every piece, where it is longer than a container) for each capacity."""
    return pack(token_counts(table(spark, sf_dir, "documents"), spark.conf.get("spark.gleaner.vocabulary", VOCABULARY)), table(spark, sf_dir, "pack_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of space used, by capacity."""
    packs = table(spark, sf_dir, "pack_sizes")
    placed = p6_containers(spark, sf_dir).groupBy("pack_id", "container").agg(F.sum("tokens").alias("used"))
    return (
        placed.join(packs, "pack_id").groupBy("pack_id", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
