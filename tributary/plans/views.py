"""The engine's relations derived from the driver's tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that time-dependent operators count from; it is always a parameter, never the clock.
AS_OF = "2024-01-30 12:00:00"

K = "cast(get_json_object(props, '$.k') as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings, one for each event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.expr(K).alias("k"))
    live = F.col("event_id") % 4 == 0
    login = F.concat(F.lit("org"), (F.col("user_id") % 7).cast("string"))
    return e.select(
        "event_id",
        login.alias("login"),
        F.concat(login, F.lit("/repo"), (F.col("user_id") % 23).cast("string")).alias("repo"),
        F.when(F.col("k") % 5 == 0, "main").otherwise(F.concat(F.lit("feat-"), (F.col("k") % 5).cast("string"))).alias("branch"),
        F.when(live, "live").otherwise("ci").alias("source"),
        F.when(live, "scan").when(F.col("k") % 3 == 0, "pull_request").otherwise("push").alias("event"),
        F.concat(F.lit("src/m"), (F.col("k") % 20).cast("string"), F.lit(".py")).alias("path"),
        (F.col("k") + 1).alias("line"),
        F.concat(F.lit("f"), (F.col("k") % 11).cast("string")).alias("func"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("click", "purchase"), "warning").otherwise("notice").alias("level"),
        F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 7).alias("sha"),
        F.col("ts").alias("found_at"),
        F.concat(F.lit("Resource leak in f"), (F.col("k") % 11).cast("string"), F.lit("()")).alias("title"),
        F.concat(F.lit("handle of "), F.col("event_type"), F.lit(" is never closed, 100%\nsee line "), (F.col("k") + 1).cast("string")).alias("message"),
        "k",
    )


FINDINGS = """findings as (
  select event_id, 'org' || (user_id % 7) as login, 'org' || (user_id % 7) || '/repo' || (user_id % 23) as repo,
    case when k % 5 = 0 then 'main' else 'feat-' || (k % 5) end as branch,
    case when event_id % 4 = 0 then 'live' else 'ci' end as source,
    case when event_id % 4 = 0 then 'scan' when k % 3 = 0 then 'pull_request' else 'push' end as event,
    'src/m' || (k % 20) || '.py' as path, k + 1 as line, 'f' || (k % 11) as func,
    case when event_type = 'error' then 'error' when event_type in ('click', 'purchase') then 'warning' else 'notice' end as level,
    substr(md5(cast(user_id as varchar)), 1, 7) as sha, ts as found_at,
    'Resource leak in f' || (k % 11) || '()' as title,
    'handle of ' || event_type || ' is never closed, 100%' || chr(10) || 'see line ' || (k + 1) as message, k
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""

FINGERPRINT_KEYS = ["repo", "branch", "source", "path", "line", "func", "sha"]
FINGERPRINT = "concat_ws('|', repo, branch, source, path, line, func, sha)"


def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow runs, one for each order."""
    o = table(spark, sf_dir, "orders")
    login = F.concat(F.lit("org"), (F.col("o_custkey") % 7).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(login, F.lit("/repo"), (F.col("o_custkey") % 23).cast("string")).alias("repo"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(F.when(F.substring("o_orderpriority", 1, 1) == "1", "main").otherwise(F.concat(F.lit("feat-"), F.substring("o_orderpriority", 1, 1)))).alias("head_branch"),
        F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "O", "success").alias("conclusion"),
        F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "pull_request").otherwise("push").alias("event"),
        F.when(F.col("o_orderkey") % 4 == 1, "Leak Check").otherwise(F.concat(F.lit("build-"), F.substring("o_orderpriority", 1, 1))).alias("name"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit("\nby customer "), F.col("o_custkey").cast("string")).alias("commit_message"),
        F.substring(F.md5((F.col("o_orderkey") % 500).cast("string").cast("binary")), 1, 7).alias("head_sha"),
        F.col("o_orderdate").alias("created_at"),
    )


RUNS = """workflow_runs as (
  select o_orderkey as run_id, 'org' || (o_custkey % 7) || '/repo' || (o_custkey % 23) as repo,
    case when o_orderkey % 10 = 0 then null when substr(o_orderpriority, 1, 1) = '1' then 'main' else 'feat-' || substr(o_orderpriority, 1, 1) end as head_branch,
    case o_orderstatus when 'F' then 'failure' when 'O' then 'success' end as conclusion,
    case when o_orderstatus = 'P' then 'in_progress' else 'completed' end as status,
    case when o_orderkey % 3 = 0 then 'pull_request' else 'push' end as event,
    case when o_orderkey % 4 = 1 then 'Leak Check' else 'build-' || substr(o_orderpriority, 1, 1) end as name,
    'order ' || o_orderkey || chr(10) || 'by customer ' || o_custkey as commit_message,
    substr(md5(cast(o_orderkey % 500 as varchar)), 1, 7) as head_sha, o_orderdate as created_at
  from orders)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.lower("c_name").alias("account_id"), F.col("c_name").alias("login"), F.concat(F.lit("org"), (F.col("c_custkey") % 7).cast("string")).alias("org"), (F.col("c_custkey") % 23).alias("repo_count"), F.col("c_custkey").alias("added_no"))


ACCOUNTS = "accounts as (select lower(c_name) as account_id, c_name as login, 'org' || (c_custkey % 7) as org, c_custkey % 23 as repo_count, c_custkey as added_no from customer)"


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ext = F.when(F.col("p_partkey") % 3 == 0, ".PY").when(F.col("p_partkey") % 3 == 1, ".py").otherwise(".ts")
    return p.select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("_"), F.col("p_partkey").cast("string"), ext).alias("path"),
        (F.col("p_size") * 10000).cast("bigint").alias("size"),
        F.md5(F.concat("p_name", (F.col("p_partkey") % 50).cast("string")).cast("binary")).alias("sha"),
        F.when(F.col("p_partkey") % 7 == 0, "tree").otherwise("blob").alias("type"),
        "p_partkey",
    )


FILES = """repo_files as (
  select replace(p_name, ' ', '/') || '_' || p_partkey || case p_partkey % 3 when 0 then '.PY' when 1 then '.py' else '.ts' end as path,
    cast(p_size * 10000 as bigint) as size, md5(p_name || (p_partkey % 50)) as sha,
    case when p_partkey % 7 = 0 then 'tree' else 'blob' end as type, p_partkey
  from part)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.md5(F.col("event_id").cast("string").cast("binary")).alias("full_sha"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.concat(F.col("event_type"), F.lit(" change"))).alias("message"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("author"),
        F.concat(F.lit("login"), (F.col("user_id") % 11).cast("string")).alias("committer"),
        F.col("ts").alias("at"),
    )


COMMITS = """commits as (
  select event_id, md5(cast(event_id as varchar)) as full_sha, case when event_id % 6 = 0 then null else event_type || ' change' end as message,
    case when user_id % 5 = 0 then null else 'user' || user_id end as author, 'login' || (user_id % 11) as committer, ts as committed_at
  from events)"""
