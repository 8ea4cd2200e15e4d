"""Keyed merges of findings: latest by fingerprint, upsert, replace scope, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators import rollups, skew

KEYS = ["repo", "branch", "source", "path", "line", "func", "sha"]


def fingerprint() -> Column:
    """The identity of a finding; absent parts are empty, an absent line is 0, an absent source is ci."""
    default = {"line": "0", "source": "ci"}
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(default.get(k, ""))) for k in KEYS])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``; Spark keeps one candidate per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(lists: list[DataFrame]) -> DataFrame:
    """The latest row of each fingerprint over several lists; at equal times the later list, then the later row."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("list_no", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return first_by(rows.withColumn("_id", fingerprint()), ["_id"], F.desc("found_at"), F.desc("list_no"), F.desc("event_id"))


def upsert(stored: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """Stored rows (_id, level, title, first_seen, last_seen) after a batch (_id, level, title) came in at ``now``."""
    b = batch.select("_id", F.col("level").alias("b_level"), F.col("title").alias("b_title"), F.lit(True).alias("hit"))
    t = F.lit(now).cast("timestamp_ntz")
    return stored.join(b, "_id", "full_outer").select(
        "_id",
        F.coalesce("b_level", "level").alias("level"),
        F.coalesce("b_title", "title").alias("title"),
        F.coalesce("first_seen", t).alias("first_seen"),
        F.when(F.col("hit"), t).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def replace_scope(stored: DataFrame, batch: DataFrame, scope: list[str]) -> DataFrame:
    """``stored`` less the rows of a scope that the batch touches but no longer holds; a hot scope is dealt to many tasks."""
    touched = batch.select(*scope).distinct().withColumn("touched", F.lit(True))
    held = batch.select("_id").distinct().withColumn("held", F.lit(True))
    return skew.salted(stored, touched, scope).join(held, "_id", "left").where("touched is null or held").drop("touched", "held")


def scan_log(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.groupBy(*keys).agg(*rollups.level_counts())
