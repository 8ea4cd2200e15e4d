"""Source units from files: a Python file, a directory tree, or a glob."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place_of(target: str) -> str:
    """A target as Spark reads it; a path without a scheme is relative to the working directory."""
    return target if "://" in target or target.startswith("file:") else os.path.abspath(target)


def collect(spark: SparkSession, targets: list[str]) -> DataFrame:
    """(path, source, sha, place) of the Python files under the targets, each path once.

    A target is a file, a directory (read recursively) or a glob; other files than .py are left out. ``place`` is the
    position of the first target that has the path, so ordering by place and path keeps the order of the targets.
    """
    out = None
    for i, t in enumerate(targets):
        try:
            rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(place_of(t))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue  # a glob that matches nothing gives no files
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"), F.lit(i).alias("place"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "path string, source string, sha string, place int")
    return out.groupBy("path").agg(F.first("source").alias("source"), F.min("place").alias("place")).select("path", "source", F.sha2("source", 256).alias("sha"), "place")


def one(spark: SparkSession, source: str, filename: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(filename, source)], "path string, source string").withColumn("sha", F.sha2("source", 256))
