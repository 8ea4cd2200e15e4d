"""Rollups of findings, runs, commits and benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators import rounds, skew


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def level_counts() -> list[Column]:
    """error, warning, notice and total of the rows at hand."""
    return [count_where(F.col("level") == x).alias(x) for x in ("error", "warning", "notice")] + [F.count("*").alias("total")]


def by_keys(findings: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    return findings.groupBy(*keys).agg(*level_counts())


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows under a total order, without a global sort."""
    return df.orderBy(*order).limit(n)


def ranked(findings: DataFrame, key: str, label: Column, limit: int) -> DataFrame:
    """Most affected values of ``key``: counts, label, and the repository if all its findings are of one."""
    g = findings.groupBy(key).agg(*level_counts(), F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    g = top(g, limit, F.desc("error"), F.desc("total"), F.asc(key))
    return g.select(F.col(key).alias("key"), label.alias("label"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("repo"), "error", "warning", "notice", "total")


def daily_buckets(findings: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts of the last ``days`` days up to ``as_of``, days without findings included."""
    today = F.to_date(F.lit(as_of))
    spine = findings.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    per = findings.where(F.to_date("found_at").between(F.date_sub(today, days - 1), today)).groupBy(F.to_date("found_at").alias("day")).agg(*level_counts())
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("error", "warning", "notice", "total")]
    return spine.join(F.broadcast(per), "day", "left").select("day", F.date_format("day", "MMM d").alias("label"), *filled)


def trend_delta(findings: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Errors since ``days`` before ``as_of`` (no upper bound) and in the ``days`` before that."""
    now, at = F.lit(as_of).cast("timestamp_ntz"), F.col("found_at")
    cut, old = F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"), F.expr(f"timestamp_ntz'{as_of}' - interval {2 * days} days")
    del now
    e = F.col("level") == "error"
    g = findings.agg(count_where(e & (at >= cut)).alias("current_errors"), count_where(e & (at >= old) & (at < cut)).alias("previous_errors"))
    return g.withColumn("delta", F.col("current_errors") - F.col("previous_errors"))


def branch_health(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs, latest run (of equal times the first) and level counts of each branch of either side."""
    named = runs.select(F.coalesce("head_branch", F.lit("(detached)")).alias("branch"), "run_id", "created_at", "conclusion")
    r = named.groupBy("branch").agg(F.count("*").alias("runs"), F.max_by(F.struct("run_id", "created_at", F.coalesce("conclusion", F.lit("unknown")).alias("conclusion")), F.struct("created_at", -F.col("run_id"))).alias("latest"))
    f = findings.groupBy("branch").agg(*level_counts())
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("error", "warning", "notice", "total")]
    return r.join(f, "branch", "full_outer").select("branch", F.coalesce("runs", F.lit(0)).alias("runs"), F.col("latest.run_id").alias("latest_run"), F.col("latest.created_at").alias("latest_at"), F.col("latest.conclusion").alias("latest_conclusion"), *zero)


def confusion(rows: DataFrame, expected: str = "expected", verdict: str = "verdict") -> DataFrame:
    """Confusion matrix with ``leak`` as the positive class; any other value counts as negative."""
    e, v = F.col(expected) == "leak", F.col(verdict) == "leak"
    g = rows.agg(count_where(e & v).alias("tp"), count_where(~e & ~v).alias("tn"), count_where(~e & v).alias("fp"), count_where(e & ~v).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return g.select("tp", "tn", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(ratio(2 * p * r, p + r), 3).alias("f1"), F.round(ratio(tp + tn, tp + tn + fp + fn), 3).alias("accuracy"))


def heatmap(commits: DataFrame, at: str = "at") -> DataFrame:
    """Commits by four-hour slot and weekday (Sunday 0): a dense grid of 6 x 7 cells."""
    grid = commits.sparkSession.range(42).select((F.col("id") / 7).cast("int").alias("slot"), (F.col("id") % 7).cast("int").alias("weekday"))
    n = commits.groupBy((F.hour(at) / 4).cast("int").alias("slot"), (F.dayofweek(at) - 1).alias("weekday")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(n), ["slot", "weekday"], "left").select("slot", "weekday", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_summary(grid: DataFrame) -> DataFrame:
    """Largest cell, shares of night (slots 0, 1, 5), morning (2) and the rest, and the peak slot (of equals the first)."""
    slots = grid.groupBy("slot").agg(F.sum("n").alias("slot_n"))
    g = slots.agg(F.sum("slot_n").alias("all"), F.sum(F.when(F.col("slot").isin(0, 1, 5), F.col("slot_n")).otherwise(0)).alias("night"), F.sum(F.when(F.col("slot") == 2, F.col("slot_n")).otherwise(0)).alias("morning"), F.min_by("slot", F.struct(-F.col("slot_n"), "slot")).alias("peak_slot"))
    pct = lambda c: F.floor(F.coalesce(F.try_divide(100.0 * F.col(c), F.col("all")), F.lit(0.0)) + 0.5).cast("bigint")
    cells = grid.agg(F.max("n").alias("max_cell"))
    return g.crossJoin(F.broadcast(cells)).select("max_cell", pct("night").alias("night_pct"), pct("morning").alias("morning_pct"), (100 - pct("night") - pct("morning")).alias("day_pct"), "peak_slot")


def with_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Position and bar width (6 to 100, in proportion to the largest total) of the few rows of a ranking."""
    w = Window.orderBy(*order)
    width = F.greatest(F.lit(6.0), F.least(F.lit(100.0), F.col("total") * 100.0 / F.max("total").over(Window.partitionBy())))
    return df.withColumn("rank", F.concat(F.lit("#"), F.row_number().over(w).cast("string"))).withColumn("width", width)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with each row's place in a global order, from 1 on: rows are dealt by ranges of the order, numbered inside
    their part, and each part begins where the rows of the parts before it end."""
    part = rounds.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = part.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each row
    begins = sizes.select("__part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return part.join(F.broadcast(begins), "__part").select(*df.columns, (F.col("begin") + F.col("__at") - F.col("first") + 1).cast("bigint").alias(name))


def paged(df: DataFrame, group: str, item: str, size: int) -> DataFrame:
    """(group, page, items): the items of each group in order, ``size`` on a page, pages from 0 on.

    Rows are numbered by ranges of (group, item), so a group of any size is spread, and no array holds more than a page.
    """
    rows = numbered(df.select(group, item), "__n", F.col(group), F.col(item))
    begins = rows.groupBy(group).agg(F.min("__n").alias("__first"))
    rows = skew.salted(rows, begins, [group]).withColumn("page", F.expr(f"(__n - __first) div {size}"))
    return rows.groupBy(group, "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
