"""The findings store fed by a stream, kept as a log of changes over a compacted base.

A batch appends what it holds (``puts``, one row per finding) and the scopes that it touches (``touches``), and nothing
else, so it writes bytes in proportion to itself. Reading merges: of each finding the rows of the base and of the log are
put in the order of their versions, and a finding ends where its scope is touched without it. When the log has grown to
GROWTH of the base, or to MOST_DELTAS batches, base and log are merged into a new base, so that a row is rewritten a
bounded number of times as the store doubles. The base is bucketed by scope; the number of buckets follows its measured
bytes, and a scope that holds more than a bucket's share is dealt to several.

Counts by COUNTED are kept along: a batch adds the rows that it brings and takes back those that it changes or expires, for
which it reads the scopes that it touches alone. So rollups, trends and top lists come from a small table.

A manifest of one row says which base and which batches make up a version. Batch b starts from manifest b - 1 and writes
its own folders, so a repeated batch is harmless; folders that only manifest b - 2 refers to are removed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import merge, rollups, skew

SCOPE = ["login", "repo", "source"]
VALUES = ["level", "title", "branch"]

#: Share of the base that the log may reach, batches in the log, and bytes of one bucket of the base.
GROWTH, MOST_DELTAS, BUCKET_BYTES = 0.25, 8, 128 << 20

PUTS = "_id string, login string, repo string, source string, level string, title string, branch string, first_seen timestamp_ntz, last_seen timestamp_ntz, version int"
TOUCHES = "login string, repo string, source string, version int"
MANIFEST = "base int, buckets int, base_bytes bigint, deltas array<int>, log_bytes bigint"
COLUMNS = ["_id", *SCOPE, *VALUES, "first_seen", "last_seen"]
COUNTED = ["repo", "branch", "source", "level", "day"]
COUNTS = "repo string, branch string, source string, level string, day date, n bigint"


@dataclass(frozen=True)
class Manifest:
    base: int = -1
    buckets: int = 0
    base_bytes: int = 0
    deltas: tuple[int, ...] = ()
    log_bytes: int = 0

    def folders(self) -> set[str]:
        return {f"log/v={v}" for v in self.deltas} | ({f"base/v={self.base}"} if self.base >= 0 else set())


def manifest(spark: SparkSession, path: str, b: int) -> Manifest:
    """What makes up the store after batch ``b``; there is nothing before batch 0."""
    if b < 0:
        return Manifest()
    r = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={b}").first()
    return Manifest(r["base"], r["buckets"], r["base_bytes"], tuple(r["deltas"]), r["log_bytes"])


def file_system(spark: SparkSession, folder: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def size(spark: SparkSession, folder: str) -> int:
    fs, place = file_system(spark, folder)
    return fs.getContentSummary(place).getLength()


def remove(spark: SparkSession, folder: str) -> None:
    fs, place = file_system(spark, folder)
    fs.delete(place, True)


def puts(batch: DataFrame) -> DataFrame:
    """One row per finding of a batch: its latest values and the times that its findings span."""
    rows = batch.withColumn("_id", merge.fingerprint()).groupBy("_id")
    latest = [F.max_by(c, F.struct("found_at", "event_id")).alias(c) for c in (*SCOPE, *VALUES)]
    return rows.agg(*latest, F.min("found_at").alias("first_seen"), F.max("found_at").alias("last_seen"))


def append(spark: SparkSession, path: str, b: int, batch: DataFrame) -> Manifest:
    """Writes batch ``b`` to the log, and to no other folder."""
    folder = f"{path}/log/v={b}"
    puts(batch).write.mode("overwrite").parquet(f"{folder}/puts")
    new = spark.read.schema(PUTS).parquet(f"{folder}/puts")
    new.select(*SCOPE).distinct().write.mode("overwrite").parquet(f"{folder}/touches")
    before = manifest(spark, path, b - 1)
    after = replace(before, deltas=(*before.deltas, b))
    changes(spark, path, before, after, new).write.mode("overwrite").parquet(f"{folder}/counts")
    return replace(after, log_bytes=before.log_bytes + size(spark, folder))


def logged(spark: SparkSession, path: str, m: Manifest, kind: str, schema: str) -> DataFrame:
    """The log of the batches in a manifest, with the version of each row."""
    places = [f"{path}/log/v={v}/{kind}" for v in m.deltas]
    if not places:
        return spark.createDataFrame([], schema)
    plain = schema.removesuffix(", version int")
    rows = spark.read.schema(plain).parquet(*places)
    return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"/log/v=(\d+)/", 1).cast("int"))


def survivors(rows: DataFrame, touches: DataFrame) -> DataFrame:
    """Live findings from puts (and base rows) of several versions and the versions that touched each scope.

    The puts of a finding are followed in order: one whose scope was touched since the put before it begins anew, any
    other extends it. What is left is live if its scope was not touched later. There are at most MOST_DELTAS + 1 puts of
    a finding and touches of a scope.
    """
    times = touches.groupBy(*SCOPE).agg(F.sort_array(F.collect_set("version")).alias("touched"))
    rows = skew.salted(rows, times, SCOPE)
    one = F.struct("version", *SCOPE, *VALUES, "first_seen", "last_seen", F.coalesce("touched", F.array().cast("array<int>")).alias("touched"))
    chain = rows.groupBy("_id").agg(F.array_sort(F.collect_list(one)).alias("chain"))

    def follow(acc: Column, x: Column) -> Column:
        gap = F.exists(acc["touched"], lambda t: (t > acc["version"]) & (t < x["version"]))
        first = F.when(gap, x["first_seen"]).otherwise(F.least(acc["first_seen"], x["first_seen"]))
        last = F.when(gap, x["last_seen"]).otherwise(F.greatest(acc["last_seen"], x["last_seen"]))
        return F.struct(x["version"].alias("version"), *[F.coalesce(x[c], F.when(~gap, acc[c])).alias(c) for c in (*SCOPE, *VALUES)], first.alias("first_seen"), last.alias("last_seen"), x["touched"].alias("touched"))

    c = F.col("chain")
    end = chain.select("_id", F.aggregate(F.slice(c, 2, F.size(c)), c[0], follow).alias("r"))
    live = end.where(~F.exists("r.touched", lambda t: t > F.col("r.version")))
    return live.select("_id", *[F.col(f"r.{x}").alias(x) for x in COLUMNS[1:]])


def rows_of(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """Rows of the base and the log, with their versions."""
    rows = logged(spark, path, m, "puts", PUTS)
    if m.base >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/base/v={m.base}/rows").select(*COLUMNS, F.lit(m.base).alias("version")))
    return rows


def state(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """The store that a manifest describes, merged on read; without a log the base is the store."""
    if m.base >= 0 and not m.deltas:
        return spark.read.parquet(f"{path}/base/v={m.base}/rows").select(*COLUMNS)
    return survivors(rows_of(spark, path, m), logged(spark, path, m, "touches", TOUCHES))


def changes(spark: SparkSession, path: str, before: Manifest, after: Manifest, new: DataFrame) -> DataFrame:
    """What a batch with the puts ``new`` adds to the counts and takes back from them.

    Only findings of scopes that it touches, and those that it holds, can change; no others are merged.
    """
    scopes = new.select(*SCOPE).distinct().withColumn("__scope", F.lit(True))
    ids = new.select("_id", F.lit(True).alias("__id"))

    def counts(m: Manifest, sign: int) -> DataFrame:
        rows = skew.salted(rows_of(spark, path, m), scopes, SCOPE).join(ids, "_id", "left").where("__scope or __id").drop("__scope", "__id")
        live = survivors(rows, logged(spark, path, m, "touches", TOUCHES))
        return live.select(*COUNTED[:-1], F.to_date("last_seen").alias("day"), F.lit(sign).alias("sign"))

    both = counts(before, -1).unionByName(counts(after, 1))
    return both.groupBy(*COUNTED).agg(F.sum("sign").alias("n")).where("n <> 0")


def counted(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """The counts of live findings by COUNTED that a manifest describes."""
    places = [f"{path}/log/v={v}/counts" for v in m.deltas] + ([f"{path}/base/v={m.base}/counts"] if m.base >= 0 else [])
    rows = spark.read.schema(COUNTS).parquet(*places) if places else spark.createDataFrame([], COUNTS)
    return rows.groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")


def counts(spark: SparkSession, path: str, b: int) -> DataFrame:
    """The counts by COUNTED after batch ``b``."""
    return counted(spark, path, manifest(spark, path, b))


def current(spark: SparkSession, path: str, b: int) -> DataFrame:
    """The store after batch ``b``. It can be read until batch b + 2 has begun."""
    return state(spark, path, manifest(spark, path, b))


def compacted(spark: SparkSession, path: str, b: int, m: Manifest) -> Manifest:
    """A new base of version ``b`` from the base and log of ``m``.

    A scope starts at the bucket of its hash and takes as many as its share of the rows asks for.
    """
    folder = f"{path}/base/v={b}"
    buckets = max(1, -(-(m.base_bytes + m.log_bytes) // BUCKET_BYTES))
    held = logged(spark, path, m, "puts", PUTS).select(*SCOPE)
    if m.base >= 0:
        held = held.unionByName(spark.read.parquet(f"{path}/base/v={m.base}/rows").select(*SCOPE))
    counts = held.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    ways = counts.select(*SCOPE, F.ceil(F.col("n") * buckets / total).cast("int").alias("ways"))
    rows = skew.salted(state(spark, path, m), ways, SCOPE)
    place = F.pmod(F.xxhash64(*SCOPE), F.lit(buckets)) + F.pmod(F.xxhash64("_id"), F.col("ways"))
    rows = rows.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int")).drop("ways")
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *SCOPE).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
    counted(spark, path, m).write.mode("overwrite").parquet(f"{folder}/counts")
    return Manifest(b, buckets, size(spark, folder), (), 0)


def write(spark: SparkSession, path: str, b: int, batch: DataFrame) -> Manifest:
    """Takes batch ``b`` into the store and compacts it if the log has outgrown its share of the base."""
    before = manifest(spark, path, b - 1)
    after = append(spark, path, b, batch)
    if len(after.deltas) > MOST_DELTAS or after.base >= 0 and after.log_bytes > GROWTH * after.base_bytes or after.base < 0 and len(after.deltas) > 1:
        after = compacted(spark, path, b, after)
    row = (after.base, after.buckets, after.base_bytes, list(after.deltas), after.log_bytes)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={b}")
    if b >= 2:
        for folder in manifest(spark, path, b - 2).folders() - before.folders() - after.folders():
            remove(spark, f"{path}/{folder}")
        remove(spark, f"{path}/manifest/v={b - 3}")
    if after.base == b:
        remove(spark, f"{path}/log/v={b}")
    return after


def start(findings: DataFrame, path: str, checkpoint: str, **options):
    """Starts the stream; every micro-batch is one version of the store."""
    spark = findings.sparkSession

    def each(batch: DataFrame, b: int) -> None:
        write(spark, path, b, batch)

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def daily(findings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Level counts by event-time day, late findings within ``lateness`` included (an extension to the batch buckets)."""
    return findings.withColumn("at", F.col("found_at").cast("timestamp")).withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("w")).agg(*rollups.level_counts()).select(F.col("w.start").alias("day"), "error", "warning", "notice", "total")
