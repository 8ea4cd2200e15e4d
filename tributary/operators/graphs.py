"""Graph queries over edge tables: paths, layers, edge clean-up."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import intervals, rounds


def paths(spark: SparkSession, edges: DataFrame, levels: int = 100) -> DataFrame:
    """All paths (unit, path) from node 0 of each unit to nodes without successors, each node once on a path.

    A path of more than ``levels`` nodes is an error, not a loss.
    """
    view = f"edges_{uuid.uuid4().hex}"  # sessions are shared by threads
    edges.createOrReplaceTempView(view)
    try:
        return spark.sql(
            f"""with recursive walk(unit, node, path) max recursion level {levels} as (
              select distinct unit, cast(0 as bigint), array(cast(0 as bigint)) from {view}
              union all
              select e.unit, e.dst, concat(w.path, array(e.dst)) from walk w join {view} e on e.unit = w.unit and e.src = w.node where not array_contains(w.path, e.dst))
            select w.unit, w.path from walk w left anti join {view} e on e.unit = w.unit and e.src = w.node"""
        )
    finally:
        spark.catalog.dropTempView(view)


def first_paths(edges: DataFrame, cap: int = 200) -> DataFrame:
    """(unit, path, truncated): of each unit the first ``cap`` paths from node 0 to nodes without successors, each node once
    on a path, in the order of a depth-first walk that takes successors by number.

    Paths grow a node a round. A path and all that grows out of it keep their place among the others, so after each round
    the first cap + 1 of a unit, complete or not, are all that can still be among its first: the work is rounds times cap,
    however many paths there are. Where cycles end paths without an exit, these may take places of others; ``truncated``
    says that a unit had more. Units without node 0 have no path. A round is a table; the one before it is removed.
    """
    spark = edges.sparkSession
    place = f"{rounds.folder(spark)}/paths-{uuid.uuid4().hex}"
    steps = rounds.written(edges.select("unit", F.col("src").cast("bigint").alias("node"), F.col("dst").cast("bigint").alias("dst")).distinct(), f"{place}/steps")
    # the places of the paths that they grew out of, and the node that each took, order paths as whole paths do
    order, k = Window.partitionBy("unit").orderBy("place", "dst"), 0
    now = rounds.written(steps.where("node = 0").select("unit", F.array("node").alias("path"), F.lit(True).alias("open"), F.lit(1).alias("n")).distinct(), f"{place}/0")
    while not now.where("open").isEmpty():
        # edges are small in files and many in rows, so their size says nothing and they are never broadcast
        grown = now.where("open").withColumn("node", F.element_at("path", -1)).join(steps.hint("merge"), ["unit", "node"], "left")
        grown = grown.where("dst is null or not array_contains(path, dst)")
        grown = grown.select("unit", F.col("n").alias("place"), "dst", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"), F.col("dst").isNotNull().alias("open"))
        done = now.where("not open").select("unit", F.col("n").alias("place"), F.lit(None).cast("bigint").alias("dst"), "path", "open")
        both = done.unionByName(grown).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap + 1)
        now, k = rounds.written(both.select("unit", "path", "open", "n"), f"{place}/{k + 1}"), k + 1
        rounds.remove(spark, f"{place}/{k - 1}")
    rounds.remove(spark, f"{place}/steps")
    return now.withColumn("truncated", F.max("n").over(Window.partitionBy("unit")) > cap).where(F.col("n") <= cap).select("unit", "path", "truncated")


#: Levels of a search after which what they found is folded into one table.
FOLD = 8


def layers(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest distance (unit, node, layer) from node 0; nodes out of reach share one layer after the last.

    Distances grow step by step over the frontier alone, until it is empty: a node that has a layer is not visited again,
    so the work is the number of edges. What is known is one table by unit and at most FOLD levels beside it; every FOLD
    levels they are folded into a new table and removed, so files and plans stay as they are however deep the graph is.
    """
    place = f"{rounds.folder(spark)}/layers-{uuid.uuid4().hex}"
    steps = rounds.written(edges.select("unit", F.col("src").alias("node"), "dst").distinct().repartition("unit"), f"{place}/steps")
    known = rounds.written(nodes.where("node = 0").select("unit", "node", F.lit(0).cast("bigint").alias("layer")), f"{place}/0")
    front, levels, tables, k = known, [], [f"{place}/0"], 0
    while True:
        k += 1
        step = front.select("unit", "node").join(steps, ["unit", "node"]).select("unit", F.col("dst").alias("node")).distinct()
        for table in (known, *levels):
            step = step.join(table, ["unit", "node"], "left_anti")
        front = rounds.written(step.withColumn("layer", F.lit(k).cast("bigint")), f"{place}/{k}")
        if front.isEmpty():
            break
        levels.append(front)
        tables.append(f"{place}/{k}")
        if len(levels) == FOLD:
            known = rounds.written(reduce(DataFrame.unionByName, levels, known).repartition("unit"), f"{place}/known-{k}")
            for old in tables:
                rounds.remove(spark, old)
            front, levels, tables = known.where(F.col("layer") == k), [], [f"{place}/known-{k}"]
    done = reduce(DataFrame.unionByName, levels, known)
    last = done.groupBy("unit").agg(F.max("layer").alias("last"))
    rest = nodes.join(done, ["unit", "node"], "left_anti").join(last, "unit").select("unit", "node", (F.col("last") + 1).alias("layer"))
    return done.unionByName(rest)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once per (unit, src, dst, guard), where the guard True is the same as none."""
    return edges.withColumn("guard", F.nullif("guard", F.lit("True"))).dropDuplicates(["unit", "src", "dst", "guard"])


def listed_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where("n_stmts > 0 or is_entry")


def enclosing(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """The narrowest function (unit, func, first, last) around each line (unit, line); null if none."""
    return intervals.narrowest(lines.select("unit", "line"), functions, ["unit"], "line", "first", "last", "func")
