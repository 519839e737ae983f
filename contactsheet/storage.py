"""The folder that driver and executors share, and tables materialised there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster a missing setting is an
    error, because a machine's own folder would not be visible to the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``table``, which nothing may read any more."""
    session = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replace(df: DataFrame, name: str, last: DataFrame | None) -> DataFrame:
    """``materialise`` for a loop: once ``df`` is written, the table of the round before (``last``, of this function) goes.
    Nothing but ``df`` may still read it."""
    now = materialise(df, name)
    if last is not None:
        drop(last)
    return now
