"""Projections of landed JSON records: runs, checks, annotations, branches, commits, files and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "struct<source:string,filename:string,fix:boolean,ensemble:boolean>"
BATCH = f"struct<files:array<{REQUEST}>>"
RUN = "struct<id:bigint,name:string,head_branch:string,head_sha:string,event:string,status:string,conclusion:string,created_at:string,head_commit:struct<message:string>,pull_requests:array<struct<number:int>>>"
ANNOTATION = "struct<path:string,start_line:int,end_line:int,annotation_level:string,title:string,message:string>"


def requests(rows: DataFrame, body: str) -> DataFrame:
    """Single analysis requests; a blank or absent source is rejected with status 400."""
    got = rows.withColumn("r", F.from_json(body, REQUEST))
    bad = F.coalesce(F.trim("r.source") == "", F.lit(True))
    return got.select(*rows.columns, F.when(bad, 400).otherwise(200).alias("status"), F.col("r.source").alias("source"), F.coalesce("r.filename", F.lit("<stdin>")).alias("filename"), F.coalesce("r.fix", F.lit(False)).alias("fix"))


def batch_requests(rows: DataFrame, body: str, key: str) -> DataFrame:
    """Files of batch requests; an empty or absent list is one row of status 400; entries that are no objects drop out."""
    got = rows.select(key, F.filter(F.from_json(body, BATCH).getField("files"), lambda x: x.isNotNull() & x["source"].isNotNull()).alias("files"))
    none = F.coalesce(F.size("files"), F.lit(0)) <= 0
    bad = got.where(none).select(key, F.lit(400).alias("status"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("source"))
    good = got.where(~none).select(key, F.explode("files").alias("f")).select(key, F.lit(200).alias("status"), "f.filename", "f.source")
    return good.unionByName(bad)


def runs(rows: DataFrame, body: str) -> DataFrame:
    """Workflow runs with defaults for what is absent, the first line of the commit message, and pull request numbers."""
    r = rows.select(F.from_json(body, RUN).alias("r"))
    return r.select(
        F.col("r.id").alias("run_id"),
        F.coalesce("r.name", F.lit("workflow")).alias("name"),
        F.coalesce("r.head_branch", F.lit("(detached)")).alias("branch"),
        F.coalesce("r.conclusion", F.lit("unknown")).alias("conclusion"),
        F.coalesce(F.get(F.split("r.head_commit.message", "\n"), 0), F.lit("")).alias("title"),
        F.coalesce(F.transform("r.pull_requests", lambda p: p["number"]), F.array().cast("array<int>")).alias("pr_numbers"),
    )


def annotations(rows: DataFrame, body: str, key: str) -> DataFrame:
    """Annotations; the end defaults to the start line, the level to notice."""
    r = rows.select(key, F.from_json(body, ANNOTATION).alias("a"))
    return r.select(key, "a.path", F.col("a.start_line").alias("start_line"), F.coalesce("a.end_line", "a.start_line").alias("end_line"), F.coalesce("a.annotation_level", F.lit("notice")).alias("level"), F.coalesce("a.title", F.lit("")).alias("title"))


PATTERN = "struct<results:array<struct<check_id:string,start:struct<line:int,col:int>,extra:struct<message:string>>>>"
LINTER = "array<struct<code:string,name:string,message:string,location:struct<row:int,column:int>>>"


def pattern_findings(rows: DataFrame, body: str, keys: list[str], priority: list[str]) -> DataFrame:
    """Findings of a pattern tool's JSON: of each line the rule that comes first in ``priority``, then in the output.

    A rule is the last part of its id; results without a line drop out, and output that does not parse has none.
    """
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), x), F.lit(0)), F.lit(len(priority) + 1))
    got = rows.select(*keys, F.posexplode(F.from_json(body, PATTERN).getField("results")).alias("place", "r")).where("r.start.line is not null")
    got = got.select(*keys, F.col("r.start.line").alias("line"), F.element_at(F.split(F.coalesce("r.check_id", F.lit("")), r"\."), -1).alias("rule"), F.col("r.extra.message").alias("message"), "place")
    return got.groupBy(*keys, "line").agg(F.min_by(F.struct("rule", "message"), F.struct(rank(F.col("rule")), "place")).alias("best")).select(*keys, F.lit("pattern").alias("tool"), "line", "best.rule", "best.message")


def linter_findings(rows: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Findings of a linter's JSON array; entries that are no objects drop out, and output that does not parse has none."""
    got = rows.select(*keys, F.explode(F.from_json(body, LINTER)).alias("r")).where("r is not null")
    return got.select(*keys, F.lit("linter").alias("tool"), F.col("r.location.row").alias("line"), F.col("r.code").alias("rule"), F.col("r.message").alias("message"))


def commits(rows: DataFrame) -> DataFrame:
    """Short sha, message or Commit, and the author by a chain of fallbacks."""
    return rows.select("event_id", F.substring("full_sha", 1, 7).alias("sha"), F.coalesce("message", F.lit("Commit")).alias("message"), F.coalesce("author", "committer", F.lit("unknown")).alias("author"))


def tree(files: DataFrame, ext: str = ".py") -> DataFrame:
    return files.where((F.col("type") == "blob") & F.lower("path").endswith(ext)).select("path", "size", "sha").orderBy("path")


def content(rows: DataFrame, encoded: str) -> DataFrame:
    """Text of base64 content that is broken into lines."""
    return rows.withColumn("content", F.decode(F.unbase64(F.regexp_replace(encoded, "\n", "")), "UTF-8"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Python files of ``after`` that ``before`` lacks or holds with another hash."""
    return after.where(F.lower("path").endswith(".py")).join(before.select("path", "sha"), ["path", "sha"], "left_anti").select("path")
