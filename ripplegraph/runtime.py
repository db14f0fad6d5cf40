"""Session helpers: checkpoint folder, size-checked broadcast, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast (about 100 bytes a row: 20 MB).
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local session may go without: it gets a temporary
    one; on a cluster, where no other machine would see that, a missing setting is an error."""
    sc = spark.sparkContext
    if (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"ripplegraph-checkpoints-{os.getpid()}"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint that survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of a frame that came from ``checkpointed``, once nothing reads it any more."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or not (path := plan.rdd().getCheckpointFile()).isDefined():
        return
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows, else as it is for a shuffled join.

    The count is an action, so ``df`` should be cheap to read (a checkpoint or a small file).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once into a compressed table in the checkpoint folder; for results too wide for a checkpoint.

    With ``by``, a column of few values, readers that ask for one of them read only its files. The table goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
