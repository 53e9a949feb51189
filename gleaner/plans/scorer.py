"""Model-in-the-loop operators: a batch scorer protocol with a deterministic default and bounded retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(rows: DataFrame, scorer: Scorer, schema: str, size: int = 32) -> DataFrame:
    """Rows scored ``size`` at a time; a scorer may return fewer rows than it got, and rows it fails on are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                try:
                    yield scorer(pdf.iloc[i : i + size])
                except Exception:  # noqa: BLE001 - a failed batch is retried by the caller
                    continue

    return rows.mapInPandas(run, schema)


def with_fallback(rows: DataFrame, key: str, scorer: Scorer, fallback: Scorer, schema: str, attempts: int = 2, size: int = 32) -> DataFrame:
    """Every row scored: what the scorer does not answer is asked again, what stays open is scored by the fallback."""
    from gleaner.tables import cut_lineage

    done = None
    open_ = rows
    for _ in range(attempts):
        got = cut_lineage(score_batches(open_, scorer, schema, size).dropDuplicates([key]))
        done = got if done is None else done.unionByName(got)
        open_ = rows.join(done.select(key), key, "left_anti")
    rest = score_batches(open_, fallback, schema, size)
    return (done.withColumn("by", F.lit("scorer")) if done is not None else rest.limit(0)).unionByName(rest.withColumn("by", F.lit("fallback")))
