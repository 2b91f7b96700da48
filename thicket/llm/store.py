"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="thicket-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, when nothing will read them again."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def tidied(df: DataFrame) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more; it does so when the driver collects garbage.

    Events refer to the plans that ended, those that wait for their listeners and the last one that a listener got; so another one
    follows, and the listeners are waited for.
    """
    sc = df.sparkSession.sparkContext
    gc.collect()
    df.sparkSession.sql("select 1").collect()
    try:
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JError:  # they still wait; the next call may do more
        pass
    sc._jvm.System.gc()
