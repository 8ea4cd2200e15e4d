"""Results of an analysis kept by content: a table of at most ``bound`` results that runs of requests share.

A run is taken as a whole: its distinct keys are looked up, what the table lacks is computed once for each distinct
content, and all keys of the run count as used in it. Recency is the run's epoch. What exceeds the bound leaves the table
in the order of its epoch, oldest first, and within the last epoch that stays in part by key; a histogram of epochs and
one of key prefixes find the place to cut, so no rows are sorted or collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import skew
from tributary.operators.rounds import cut

#: Hex digits of a key that one level of the histogram tells apart.
DIGITS = 3


def content_key(text: str, config: str = "") -> F.Column:
    """Hash of a content and of the configuration that its result depends on; a null content has none."""
    return F.sha2(F.concat(F.lit(config), F.lit("\n"), F.col(text)), 256)


@dataclass(frozen=True)
class Run:
    """Answers of one run, the table after it, and counts (one row: epoch, requests, hits, misses, evicted, kept)."""

    answers: DataFrame
    table: DataFrame
    counts: DataFrame


def run(table: DataFrame | None, requests: DataFrame, epoch: int, compute: Callable[[DataFrame], DataFrame], bound: int, text: str = "text", config: str = "") -> Run:
    """Answers ``requests`` from ``table`` (key, results, epoch) and by ``compute``, and takes what is new into the table.

    ``compute`` gets (key, text) of distinct contents that the table lacks and returns key and result columns. Of
    requests of equal content all but the first are hits, as is every request whose content is in the table; requests
    without content are neither, and their answer is null.
    """
    asked = requests.withColumn("key", content_key(text, config))
    keys = cut(asked.where("key is not null").groupBy("key").agg(F.count("*").alias("asked")))
    missing = keys if table is None else keys.join(table.select("key"), "key", "left_anti")
    # a content that is asked for often is sent once by each task
    contents = asked.groupBy("key").agg(F.any_value(text).alias("text")).join(missing.select("key"), "key", "left_semi")
    new = cut(compute(contents).withColumn("epoch", F.lit(epoch)))
    held = new
    if table is not None:
        seen = table.join(keys.select("key", F.lit(True).alias("hit")), "key", "left")
        held = seen.withColumn("epoch", F.when(F.col("hit"), F.lit(epoch)).otherwise(F.col("epoch"))).drop("hit").unionByName(new)
    held = cut(held)
    answers = skew.salted(asked, held.drop("epoch"), ["key"])
    kept = evicted(held, bound)
    total = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"))
    sizes = [new.agg(F.count("*").alias("misses")), held.agg(F.count("*").alias("held")), kept.agg(F.count("*").alias("kept"))]
    for one in sizes:  # rows of one count each
        total = total.crossJoin(F.broadcast(one))
    counts = total.select(F.lit(epoch).alias("epoch"), F.col("asked").alias("requests"), (F.col("asked") - F.col("misses")).alias("hits"), "misses", (F.col("held") - F.col("kept")).alias("evicted"), "kept")
    return Run(answers, kept, counts)


def evicted(held: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows (all, if there are no more) of latest epoch, of one epoch those of smallest key.

    Histograms reach the driver, never rows: one of epochs, then, for the epoch that stays in part, one of 4096 prefixes
    of keys for each level until a prefix fits.
    """
    left = bound
    for r in held.groupBy("epoch").count().orderBy(F.desc("epoch")).toLocalIterator():
        if r["count"] > left:
            break
        left -= r["count"]
    else:
        return held
    inside, prefix = held.where(F.col("epoch") == r["epoch"]), ""
    while True:
        bins = inside.where(F.col("key").startswith(prefix)).groupBy(F.substring("key", 1, len(prefix) + DIGITS).alias("p")).count()
        for p, n in sorted(bins.collect()):
            if n > left:
                prefix = p
                break
            left -= n
        if not left:
            return held.where((F.col("epoch") > r["epoch"]) | (F.col("epoch") == r["epoch"]) & (F.col("key") < prefix))
