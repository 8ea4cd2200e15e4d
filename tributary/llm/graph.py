"""Connected components of edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of a partition: a table of few edges is kept in few files, one of many in as many as the shuffle makes.
EDGES = 100_000

#: Tasks that the edges of one node are dealt to where they meet its smallest neighbour.
HUB_WAYS = 4


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node that it is connected with.

    Alternating large-star and small-star steps: every step hangs a node's neighbours on its smallest one, so a chain
    halves each time. Each round is written to the shared folder, where the round before it is removed; only a count and
    a checksum reach the driver.
    """
    spark = edges.sparkSession
    folder = f"{common.checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    now = common.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    mark = sign(now)
    now = now.coalesce(1 + mark[0] // EDGES)
    for k in range(most_rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = common.salted(both, low, "a", HUB_WAYS).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.distinct().coalesce(1 + 2 * mark[0] // EDGES)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = common.salted(large, low, "a", HUB_WAYS)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now, before = common.written(small.coalesce(1 + 2 * mark[0] // EDGES), f"{folder}/{k + 1}"), mark
        common.remove(spark, f"{folder}/{k}")
        mark = sign(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
