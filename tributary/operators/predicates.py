"""Filters, classifications and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mentions(needles: list[str], *columns: str) -> Column:
    """Whether the columns, joined by blanks, hold one of the needles, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    cond = F.lit(False)
    for n in needles:
        cond = cond | hay.contains(n.lower())
    return cond


def filter_findings(findings: DataFrame, level: str = "all", event: str = "all", branch: str = "all", repo: str = "all", text: str = "") -> DataFrame:
    """Equality filters, where ``all`` admits everything, and a substring of path, message, title, function and branch."""
    for name, value in (("level", level), ("event", event), ("branch", branch), ("repo", repo)):
        if value != "all":
            findings = findings.where(F.col(name) == value)
    wanted = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", "path", "message", "title", F.coalesce("func", F.lit("")), "branch"))
    return findings.where(hay.contains(wanted)) if wanted else findings


def named_or_all(rows: DataFrame, named: Column, scope: str) -> DataFrame:
    """Named rows of each scope, or all of its rows where none is named."""
    w = Window.partitionBy(scope)
    tagged = rows.withColumn("__named", named).withColumn("__any", F.max("__named").over(w))
    return tagged.where("__named or not __any").drop("__named", "__any")


def level_of(annotation_level: Column) -> Column:
    return F.when(annotation_level == "failure", "error").when(annotation_level == "warning", "warning").otherwise("notice")


def func_from_title(title: str) -> Column:
    return F.nullif(F.regexp_extract(title, r"in\s+([A-Za-z_][A-Za-z0-9_]*)\(\)", 1), F.lit(""))


#: Categories by parts of the acquiring call's name; the first that fits counts.
CATEGORIES = [
    ("socket", ["socket"]),
    ("database", ["sqlite", "psycopg", "mysql", "pymongo", "mongo"]),
    ("http", ["requests", "httpx"]),
    ("process", ["Popen", "Process", "subprocess", "multiprocessing"]),
    ("tempfile", ["tempfile"]),
]


def resource_category(acquire: str) -> Column:
    out = None
    for name, parts in CATEGORIES:
        cond = F.col(acquire).rlike("|".join(parts))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("file")


def category_of(acquire: str) -> str:
    return next((name for name, parts in CATEGORIES if any(p in acquire for p in parts)), "file")


def eligible(files: DataFrame, below: int, limit: int) -> DataFrame:
    """Python blobs of 1 to ``below`` - 1 bytes, the first by path."""
    return files.where((F.col("type") == "blob") & F.lower("path").endswith(".py") & (F.col("size") > 0) & (F.col("size") < below)).orderBy("path").limit(limit)


def risk(confirmed: str, total: str) -> Column:
    return F.when(F.col(total) == 0, "CLEAN").when(F.col(confirmed) > 3, "CRITICAL").when(F.col(confirmed) > 0, "HIGH").otherwise("MEDIUM")


def plan(key: Column) -> Column:
    k = F.lower(key)
    return F.when(k.contains("team"), "team").when(k.contains("business"), "business").when(k.contains("ent"), "enterprise").otherwise("community")


def repo_reference(rows: DataFrame, raw: str) -> DataFrame:
    """owner and repo of a URL or path; both null where there are not two parts."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^https?://[^/]+/", ""), r"\.git$", "")
    parts = F.split(F.regexp_replace(bare, "^/+|/+$", ""), "/")
    two = F.size(parts) >= 2
    return rows.withColumn("owner", F.when(two, F.get(parts, 0))).withColumn("repo", F.when(two, F.get(parts, 1)))


def time_ago(at: str, now: str) -> Column:
    """Age at ``now`` in the largest whole unit; a future time is just now, no time a dash."""
    s = F.greatest(F.lit(0), F.floor(F.expr(f"timestampdiff(MICROSECOND, {at}, timestamp_ntz'{now}')") / 1e6))
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name + " ago"))
    day = 86400
    return (
        F.when(F.col(at).isNull(), "-").when(s < 45, "just now").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < day, unit(3600, "h"))
        .when(s < 30 * day, unit(day, "d")).when(s < 360 * day, unit(30 * day, "mo")).otherwise(unit(360 * day, "y"))
    )


def conclusion_label(status: str, conclusion: str) -> Column:
    return F.when(F.col(status) != "completed", F.replace(status, F.lit("_"), F.lit(" "))).otherwise(F.coalesce(conclusion, F.lit("unknown")))


def event_label(event: str, prs: Column) -> Column:
    pr = F.when(F.size(prs) > 0, F.concat(F.lit("PR #"), F.get(prs, 0).cast("string"))).otherwise("pull request")
    return F.when(F.col(event) == "pull_request", pr).when(F.col(event) == "scan", "on-demand scan").otherwise(F.replace(event, F.lit("_"), F.lit(" ")))


def stored(findings: DataFrame, filters: dict[str, str], limit: int = 500) -> DataFrame:
    """A page of stored findings, newest first; the login is compared in lower case, the limit is 2000 at most."""
    for name in ("login", "repo", "branch", "level", "source"):
        if name in filters:
            findings = findings.where(F.col(name) == (filters[name].lower() if name == "login" else filters[name]))
    return findings.orderBy(F.desc("found_at"), F.desc("event_id")).limit(min(limit, 2000))
