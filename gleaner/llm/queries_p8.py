"""Queries of problem 8 (subject areas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.subjects import document_subjects, fit
from gleaner.tables import table


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return document_subjects(documents, *fit(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject_id")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents and characters by subject."""
    chars = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _subjects(spark, sf_dir).join(chars, "doc_id").groupBy("subject_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {}
