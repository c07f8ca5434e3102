"""Access to the named Parquet tables of one data directory, and the end of long lineages."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder, which is far smaller than a checkpoint; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.stored_at = path
    return table_


def forget(*tables: DataFrame) -> None:
    """Drops tables of :func:`stored` before the driver ends; shuffle files and checkpoints that nothing refers to go too."""
    for t in tables:
        _drop(t.sparkSession, t.stored_at)
        gc.collect()
        t.sparkSession._jvm.System.gc()


def beside(stream: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row of ``stream`` beside every one of ``blocks``, in a task for each partition of ``blocks``; nothing is shuffled.

    The task holds its blocks and reads the rows of the stream one after the other.
    """
    return stream.coalesce(1).hint("shuffle_replicate_nl").crossJoin(blocks)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: whoever owns the shared folder clears it
        return
