"""Lineage cuts that survive the loss of an executor.

A step that is read more than once is written as Parquet into the shared folder
that the cluster names in ``spark.checkpoint.dir`` and read back. Unlike
``Dataset.checkpoint`` the plan runs once, the files are columnar and compressed,
and the optimizer sees their true size.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where ``spark.checkpoint.dir`` is unset and the master is this machine, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster must name one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or LOCAL_FOLDER)
        folder = context.getCheckpointDir()
    return folder


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Run ``df`` once, keep its rows in the shared folder, and return a frame that reads them.

    The files live as long as the session, whose folder under the shared one is its
    own: rows that are read again after an executor is lost must still be there.
    ``discard`` removes them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(discard)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def discard() -> None:
    """Remove what ``durable`` wrote in this process; no frame that reads it may be used again."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            continue
