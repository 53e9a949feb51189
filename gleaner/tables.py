"""Access to the driver's Parquet tables and bounded broadcasting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows, else ``df`` as it is.

    The rows are fetched once (never more than ``max_rows + 1``) and turned into a local relation, so that a small
    dimension or per-source model is neither computed twice nor shuffled against. A larger input keeps its plan and
    joins by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def fixed_rows(df: DataFrame, bound: int, what: str) -> list:
    """The rows of a table that is small by its nature, for the driver; more than ``bound`` of them are an error, never cut off."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} {what}: too many to hold on the driver")
    return rows


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for kernels that work harder than the reader.

    Large tables come in far more partitions than that and are left as they are; only one that fits a few file splits is
    dealt out anew.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if parts >= cores or not parts else scan.repartition(cores)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, as the session names it.

    Where none is set a session on one machine (tests) gets a temporary one; on a cluster, whose executors would not see it,
    that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a table that is written and read again, in the folder that all executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder the cluster names in ``spark.checkpoint.dir``."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
