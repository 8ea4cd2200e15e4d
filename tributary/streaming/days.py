"""Day counts kept by a stateful stream of changes, with what expired findings take back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEVELS = ["error", "warning", "notice"]
DAYS = "repo string, part int, day date, error bigint, warning bigint, notice bigint, total bigint"

#: State keys that the days of one repository are dealt to.
PARTS = 8

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayCounts(StatefulProcessor):
    """Counts of each day of a repository in one map state; changed days are put out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day date", "error bigint, warning bigint, notice bigint")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        changed: dict = {}
        for r in rows:
            if r.day not in changed:
                held = self.days.getValue((r.day,)) if self.days.containsKey((r.day,)) else (0, 0, 0)
                changed[r.day] = [*held]
            if r.level in LEVELS:
                changed[r.day][LEVELS.index(r.level)] += r.n
        for day, counts in changed.items():
            if any(counts):
                self.days.updateValue((day,), tuple(counts))
            else:
                self.days.removeKey((day,))
            yield Row(repo=key[0], part=key[1], day=day, error=counts[0], warning=counts[1], notice=counts[2], total=sum(counts))

    def close(self) -> None:
        pass


def start(changes: DataFrame, path: str, checkpoint: str, **options):
    """Starts the stream over changes (repo, level, day, n): signed numbers of findings that came or went.

    Every batch appends the new counts of the days that it changes to ``path``. ``changes`` must be of a session whose
    state store is PROVIDER (``session``). A repository's days are dealt to PARTS keys, so a busy one is not one task's.
    """
    part = F.pmod(F.datediff("day", F.lit("2000-01-01")), F.lit(PARTS)).cast("int")
    keyed = changes.where("repo is not null and day is not null").select("repo", part.alias("part"), "day", "level", "n")
    counts = keyed.groupBy("repo", "part").transformWithState(statefulProcessor=DayCounts(), outputStructType=T.StructType.fromDDL(DAYS), outputMode="Update", timeMode="None")

    def each(batch: DataFrame, b: int) -> None:
        batch.drop("part").write.mode("overwrite").parquet(f"{path}/batch={b}")

    return counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def session(spark):
    """A session beside ``spark`` whose streams keep their state in PROVIDER; the settings of ``spark`` stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def current(spark, path: str) -> DataFrame:
    """(repo, day, error, warning, notice, total): the last counts of each day that has findings."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("repo", "day").agg(F.max_by(F.struct(*LEVELS, "total"), "batch").alias("c"))
    return last.select("repo", "day", "c.*").where("total <> 0")


def buckets(counts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts of the last ``days`` days up to ``as_of`` over all repositories, days without findings included."""
    today = F.to_date(F.lit(as_of))
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    per = counts.groupBy("day").agg(*[F.sum(c).alias(c) for c in (*LEVELS, "total")])
    return spine.join(per, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*LEVELS, "total")])
