"""Sessions, checkpoints and scratch tables.

Anything that must outlive a stage goes to the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share; a lost executor then
costs a re-read, not a recomputation of the whole lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "newsdesk", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what ``spark.checkpoint.dir`` names, else what the session has been given.

    A session on one machine gets a temporary one; on a cluster, where executors don't see each other's
    disks, the lack of a name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='newsdesk-')}")
    return named or os.path.dirname(context.getCheckpointDir())


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{checkpoint_dir(spark)}/newsdesk/{name}-{uuid.uuid4().hex}"


def hadoop_file(spark: SparkSession, path: str):
    """A path's file system and the path, by which any store is reached that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the files go when the driver ends."""
    return discardable(df, name)[0]


def discardable(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``stored``, and a call that deletes the files when nothing reads them any longer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    files, at = hadoop_file(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), lambda: files.delete(at, True)
