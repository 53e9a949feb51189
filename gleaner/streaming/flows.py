"""Structured Streaming twins of the batch operators; each is checked against its batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.tables import shared_folder


def read_folder(spark: SparkSession, folder: str, schema, files: int = 4) -> DataFrame:  # noqa: ANN001
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, length: str, late: str) -> DataFrame:
    """Counts per tumbling window and key, late events up to ``late`` included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_sums(events: DataFrame, ts: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide)).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "total", "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(items: DataFrame, ts: str, keys: list[str], memory: str) -> DataFrame:
    """The first of rows with equal keys within the stream's memory."""
    return items.withWatermark(ts, memory).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """A running total per key, kept as state from batch to batch."""

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in pdfs:
            n += len(pdf)
            total += float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} string, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drive a stream to the end of what is there and return what it wrote.

    Each micro-batch is a Parquet folder of its own (written anew if the batch is repeated), and the stream's checkpoint
    lies beside them in the shared folder; nothing is gathered on the driver. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    return (out.filter(F.col("batch") == last) if mode == "complete" else out).drop("batch")
