"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local session may have none set, and gets one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        set_to = spark.conf.get("spark.checkpoint.dir", "")
        if not set_to and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(set_to or os.path.join(tempfile.gettempdir(), "tributary-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, place: str) -> DataFrame:
    """``df`` written as a table and read again; unlike a checkpoint it does not carry Spark's estimate of its size on."""
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a table of intermediate data that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
