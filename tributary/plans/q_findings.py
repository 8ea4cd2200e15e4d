"""Queries over findings, runs, accounts, files and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import merge, predicates, rollups, skew, trigrams
from tributary.plans import views as v
from tributary.plans.base import query

W = "with " + v.FINDINGS
LEVELS = "count(*) filter (level = 'error') as error, count(*) filter (level = 'warning') as warning, count(*) filter (level = 'notice') as notice, count(*) as total"


@query("a1_level_counts", f"{W} select {LEVELS} from findings")
def a1(s, d):
    return v.findings(s, d).agg(*rollups.level_counts())


#: Ids on a page of a group.
PAGE = 500


@query("a2_group_by_branch", f"{W}, g as (select branch, {LEVELS} from findings group by branch), p as (select branch, event_id, (row_number() over (partition by branch order by event_id) - 1) // {PAGE} as page from findings) select branch, page, error, warning, notice, total, items from g join (select branch, page, list_sort(list(event_id)) as items from p group by 1, 2) using (branch)")
def a2_branch(s, d):
    f = v.findings(s, d)
    return skew.salted(rollups.paged(f, "branch", "event_id", PAGE), rollups.by_keys(f, "branch"), ["branch"])


@query("a2_group_by_file", f"{W} select path, {LEVELS} from findings group by path")
def a2_file(s, d):
    return rollups.by_keys(v.findings(s, d), "path")


@query("a2_group_by_repo", f"{W} select repo, {LEVELS} from findings group by repo order by error desc, total desc, repo")
def a2_repo(s, d):
    return rollups.by_keys(v.findings(s, d), "repo").orderBy(F.desc("error"), F.desc("total"), "repo")


@query("a3_level_rollup", f"{W} select level, count(*) as n from findings group by level")
def a3(s, d):
    return v.findings(s, d).groupBy("level").agg(F.count("*").alias("n"))


@query("a4_repo_rollup", f"{W} select repo, count(*) as total, count(*) filter (level = 'error') as errors from findings group by repo order by errors desc, total desc, repo limit 50")
def a4(s, d):
    g = v.findings(s, d).groupBy("repo").agg(F.count("*").alias("total"), rollups.count_where(F.col("level") == "error").alias("errors"))
    return rollups.top(g, 50, F.desc("errors"), F.desc("total"), F.asc("repo"))


@query("a5_repo_branch_rollup", f"{W} select repo, branch, count(*) as total, count(*) filter (level = 'error') as errors from findings group by repo, branch order by errors desc, total desc, repo, branch limit 100")
def a5(s, d):
    g = v.findings(s, d).groupBy("repo", "branch").agg(F.count("*").alias("total"), rollups.count_where(F.col("level") == "error").alias("errors"))
    return rollups.top(g, 100, F.desc("errors"), F.desc("total"), F.asc("repo"), F.asc("branch"))


RANK = "case when min(repo) = max(repo) then min(repo) end as repo"


@query("a6_top_branches", f"{W} select branch as key, branch as label, {RANK}, {LEVELS} from findings group by branch order by error desc, total desc, key limit 7")
def a6_branches(s, d):
    return rollups.ranked(v.findings(s, d), "branch", F.col("branch"), 7)


@query("a6_top_files", f"{W} select path as key, string_split(path, '/')[-1] as label, {RANK}, {LEVELS} from findings group by path order by error desc, total desc, key limit 6")
def a6_files(s, d):
    return rollups.ranked(v.findings(s, d), "path", F.element_at(F.split("path", "/"), -1), 6)


@query("a7_event_split", f"{W} select count(*) filter (event = 'pull_request') as pull_request, count(*) filter (event = 'scan') as scan, count(*) filter (event not in ('pull_request', 'scan')) as push from findings")
def a7(s, d):
    e = F.col("event")
    return v.findings(s, d).agg(F.count_if(e == "pull_request").alias("pull_request"), F.count_if(e == "scan").alias("scan"), F.count_if(~e.isin("pull_request", "scan")).alias("push"))


@query(
    "a8_daily_buckets",
    f"""{W}, spine as (select cast(unnest(generate_series(timestamp '{v.AS_OF[:10]}' - interval 13 days, timestamp '{v.AS_OF[:10]}', interval 1 day)) as date) as day),
    per as (select cast(found_at as date) as day, {LEVELS} from findings group by 1)
    select day, strftime(day, '%b %-d') as label, coalesce(error, 0) as error, coalesce(warning, 0) as warning, coalesce(notice, 0) as notice, coalesce(total, 0) as total from spine left join per using (day)""",
)
def a8(s, d):
    return rollups.daily_buckets(v.findings(s, d), v.AS_OF, 14)


@query("w11_last_seven_buckets", f"{W}, spine as (select cast(unnest(generate_series(timestamp '{v.AS_OF[:10]}' - interval 6 days, timestamp '{v.AS_OF[:10]}', interval 1 day)) as date) as day) select day, count(f.event_id) as total from spine left join findings f on cast(found_at as date) = day group by day")
def w11(s, d):
    return rollups.daily_buckets(v.findings(s, d), v.AS_OF, 14).select("day", "total").orderBy(F.desc("day")).limit(7)


T, C = f"timestamp '{v.AS_OF}'", "level = 'error' and found_at"


@query("a9_trend_delta", f"{W}, g as (select count(*) filter ({C} >= {T} - interval 7 days) as current_errors, count(*) filter ({C} >= {T} - interval 14 days and found_at < {T} - interval 7 days) as previous_errors from findings) select *, current_errors - previous_errors as delta from g")
def a9(s, d):
    return rollups.trend_delta(v.findings(s, d), v.AS_OF)


@query(
    "w8_weekly_change",
    f"{W}, g as (select cast(floor(date_diff('day', date '2024-01-01', cast(found_at as date)) / 7) as bigint) as week, count(*) filter (level = 'error') as errors from findings group by 1) select week, errors, errors - lag(errors) over (order by week) as change from g",
)
def w8(s, d):
    week = F.floor(F.datediff(F.to_date("found_at"), F.lit("2024-01-01").cast("date")) / 7)
    g = v.findings(s, d).groupBy(week.alias("week")).agg(F.count_if(F.col("level") == "error").alias("errors"))
    return g.withColumn("change", F.expr("errors - lag(errors) over (order by week)"))


@query(
    "a10_branch_health",
    f"""{W}, {v.RUNS}, r as (select coalesce(head_branch, '(detached)') as branch, count(*) as runs, max({{'t': created_at, 'p': -run_id, 'id': run_id, 'c': coalesce(conclusion, 'unknown')}}) as latest from workflow_runs group by 1),
    f as (select branch, {LEVELS} from findings group by branch)
    select branch, coalesce(runs, 0) as runs, latest.id as latest_run, latest.t as latest_at, latest.c as latest_conclusion, coalesce(error, 0) as error, coalesce(warning, 0) as warning, coalesce(notice, 0) as notice, coalesce(total, 0) as total from r full outer join f using (branch)""",
)
def a10(s, d):
    return rollups.branch_health(v.workflow_runs(s, d), v.findings(s, d))


@query(
    "j9_runs_findings_full_outer",
    f"{W}, {v.RUNS}, r as (select coalesce(head_branch, '(detached)') as branch, count(*) as runs from workflow_runs group by 1), f as (select branch, count(*) as findings from findings group by 1) select branch, runs, findings from r full outer join f using (branch)",
)
def j9(s, d):
    r = v.workflow_runs(s, d).groupBy(F.coalesce("head_branch", F.lit("(detached)")).alias("branch")).agg(F.count("*").alias("runs"))
    return r.join(v.findings(s, d).groupBy("branch").agg(F.count("*").alias("findings")), "branch", "full_outer").select("branch", "runs", "findings")


@query(
    "j10_branches_without_rows",
    f"{W}, {v.RUNS}, known as (select distinct branch from findings) select branch, true as has_findings from known union all select distinct head_branch, false from workflow_runs where head_branch is not null and head_branch not in (select branch from known)",
)
def j10(s, d):
    known = v.findings(s, d).select("branch").distinct()
    more = v.workflow_runs(s, d).where("head_branch is not null").select(F.col("head_branch").alias("branch")).distinct().join(known, "branch", "left_anti")
    return known.withColumn("has_findings", F.lit(True)).unionByName(more.withColumn("has_findings", F.lit(False)))


@query(
    "a11_account_summaries",
    f"{W}, {v.ACCOUNTS}, f as (select login as org, count(distinct repo) as scanned, {LEVELS} from findings group by 1), a as (select org, count(*) as accounts, cast(sum(repo_count) as bigint) as repos from accounts group by 1) select org, accounts, repos, coalesce(scanned, 0) as scanned, coalesce(error, 0) as error, coalesce(total, 0) as total from a left join f using (org)",
)
def a11(s, d):
    f = v.findings(s, d).withColumnRenamed("login", "org").groupBy("org").agg(F.countDistinct("repo").alias("scanned"), *rollups.level_counts())
    a = v.accounts(s, d).groupBy("org").agg(F.count("*").alias("accounts"), F.sum("repo_count").alias("repos"))
    z = [F.coalesce(c, F.lit(0)).alias(c) for c in ("scanned", "error", "total")]
    return a.join(f, "org", "left").select("org", "accounts", "repos", *z)


@query(
    "a12_global_counts",
    f"with {v.RUNS}, g as (select repo, count(*) as n, max(created_at) as latest from workflow_runs group by repo) select count(*) as repos, cast(sum(n) as bigint) as runs, count(*) filter (n > 5) as with_many, max(latest) as latest from g",
)
def a12(s, d):
    g = v.workflow_runs(s, d).groupBy("repo").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))
    return g.agg(F.count("*").alias("repos"), F.sum("n").alias("runs"), F.count_if(F.col("n") > 5).alias("with_many"), F.max("latest").alias("latest"))


@query("a13_ci_coverage", f"{W} select login, cast(case when count(*) = 0 then 100 else floor(100.0 * count(*) filter (source = 'ci') / count(*) + 0.5) end as bigint) as pct from findings group by login")
def a13(s, d):
    g = v.findings(s, d).groupBy("login").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "ci").alias("ci"))
    return g.select("login", F.when(F.col("n") == 0, 100).otherwise(F.floor(100.0 * F.col("ci") / F.col("n") + 0.5)).cast("bigint").alias("pct"))


@query("a14_scan_summary", f"{W} select path, count(*) as total, count(*) filter (k % 3 <> 1) as path_leaks, count(*) filter (k % 3 > 0) as exception_leaks, count(distinct line) as acquires, count(distinct func) as functions from findings group by path")
def a14(s, d):
    # kinds by k: 0 path, 1 exception, 2 both; a finding of both kinds is counted by either
    k = F.col("k") % 3
    return v.findings(s, d).groupBy("path").agg(F.count("*").alias("total"), F.count_if(k != 1).alias("path_leaks"), F.count_if(k > 0).alias("exception_leaks"), F.countDistinct("line").alias("acquires"), F.countDistinct("func").alias("functions"))


@query("a15_ci_totals", f"{W} select count(*) filter (level = 'error') as definite, count(*) filter (k % 3 > 0) as exception, count(*) filter (level <> 'error') as potential from findings")
def a15(s, d):
    return v.findings(s, d).agg(F.count_if(F.col("level") == "error").alias("definite"), F.count_if(F.col("k") % 3 > 0).alias("exception"), F.count_if(F.col("level") != "error").alias("potential"))


@query("a16_batch_total", f"{W}, files as (select path, list(event_id) as leaks from findings group by path) select cast(sum(len(leaks)) as bigint) as total_leaks, count(*) as files from files")
def a16(s, d):
    g = v.findings(s, d).groupBy("path").agg(F.count("event_id").alias("leaks"))
    return g.agg(F.sum("leaks").alias("total_leaks"), F.count("*").alias("files"))


VERDICT = "case event_id % 4 when 0 then 'confirmed_path_leak' when 1 then 'confirmed_exception_unsafe' when 2 then 'refuted_safe' else 'unverified' end"


@query("a17_verdict_counts", f"{W}, g as (select login, {VERDICT} as verdict from findings) select login, count(*) filter (verdict like 'confirmed%') as confirmed, count(*) filter (verdict = 'refuted_safe') as refuted, count(*) filter (verdict = 'unverified') as unverified, cast(round_even(100.0 * count(*) filter (verdict = 'refuted_safe') / count(*), 0) as bigint) as noise_reduction from g group by login")
def a17(s, d):
    verdict = F.expr(f"{VERDICT} as verdict")
    g = v.findings(s, d).select("login", verdict).groupBy("login").agg(F.count_if(F.col("verdict").startswith("confirmed")).alias("confirmed"), F.count_if(F.col("verdict") == "refuted_safe").alias("refuted"), F.count_if(F.col("verdict") == "unverified").alias("unverified"), F.count("*").alias("n"))
    return g.select("login", "confirmed", "refuted", "unverified", F.bround(100.0 * F.col("refuted") / F.col("n"), 0).cast("bigint").alias("noise_reduction"))


@query(
    "a18_confusion_matrix",
    """with r as (select case when event_id % 3 = 0 then 'leak' when event_id % 3 = 1 then 'safe' else 'potential' end as expected, case when event_id % 5 < 2 then 'leak' else 'safe' end as verdict from events),
    g as (select count(*) filter (expected = 'leak' and verdict = 'leak') as tp, count(*) filter (expected <> 'leak' and verdict <> 'leak') as tn, count(*) filter (expected <> 'leak' and verdict = 'leak') as fp, count(*) filter (expected = 'leak' and verdict <> 'leak') as fn from r),
    m as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0.0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0.0) as q from g)
    select tp, tn, fp, fn, round(p, 3) as precision, round(q, 3) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0.0), 3) as f1, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::double, 0.0), 3) as accuracy from m""",
)
def a18(s, d):
    n = F.col("event_id")
    rows = v.table(s, d, "events").select(F.when(n % 3 == 0, "leak").when(n % 3 == 1, "safe").otherwise("potential").alias("expected"), F.when(n % 5 < 2, "leak").otherwise("safe").alias("verdict"))
    return rollups.confusion(rows)


@query(
    "a19_token_cost",
    """with u as (select event_type as model, event_id * 3 % 700 as tokens_in, event_id * 7 % 900 as tokens_out, event_id % 50 = 0 as failed from events), p(model, pin, pout) as (values ('click', 0.15, 0.6), ('view', 2.5, 10.0)),
    g as (select model, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, count(*) filter (failed) as errors from u group by model)
    select g.model, tokens_in, tokens_out, tokens_in + tokens_out as tokens, errors, round(tokens_in / 1e6 * coalesce(pin, 0.5)::double + tokens_out / 1e6 * coalesce(pout, 1.5)::double, 4) as cost from g left join p on g.model = p.model""",
)
def a19(s, d):
    n = F.col("event_id")
    prices = s.createDataFrame([("click", 0.15, 0.6), ("view", 2.5, 10.0)], "model string, pin double, pout double")
    u = v.table(s, d, "events").select(F.col("event_type").alias("model"), (n * 3 % 700).alias("tokens_in"), (n * 7 % 900).alias("tokens_out"), (n % 50 == 0).alias("failed"))
    g = u.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if("failed").alias("errors"))
    cost = F.col("tokens_in") / 1e6 * F.coalesce("pin", F.lit(0.5)) + F.col("tokens_out") / 1e6 * F.coalesce("pout", F.lit(1.5))
    return g.join(F.broadcast(prices), "model", "left").select("model", "tokens_in", "tokens_out", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "errors", F.round(cost, 4).alias("cost"))


@query(
    "a20_language_breakdown",
    "with r as (select coalesce(case when p_size % 6 = 0 then null else p_brand end, 'Other') as language from part), n as (select count(*) as n_all from r) select language, count(*) as n, cast(floor(100.0 * count(*) / any_value(n_all) + 0.5) as bigint) as pct from r, n group by language order by n desc, language limit 5",
)
def a20(s, d):
    r = v.table(s, d, "part").select(F.coalesce(F.when(F.col("p_size") % 6 == 0, F.lit(None)).otherwise(F.col("p_brand")), F.lit("Other")).alias("language"))
    g = r.groupBy("language").agg(F.count("*").alias("n"))
    top = rollups.top(g, 5, F.desc("n"), F.asc("language"))
    return top.crossJoin(F.broadcast(r.agg(F.count("*").alias("n_all")))).select("language", "n", F.floor(100.0 * F.col("n") / F.col("n_all") + 0.5).alias("pct"))


CELLS = f"with {v.COMMITS}, cells as (select cast(floor(extract('hour' from committed_at) / 4) as integer) as slot, cast(extract('dow' from committed_at) as integer) as weekday, count(*) as c from commits group by 1, 2), grid as (select cast(a.range as integer) as slot, cast(b.range as integer) as weekday, coalesce(c, 0) as n from range(6) a, range(7) b left join cells on slot = a.range and weekday = b.range)"


@query("a21_heatmap", f"{CELLS} select slot, weekday, n from grid")
def a21(s, d):
    return rollups.heatmap(v.commits(s, d))


@query(
    "a21_heatmap_summary",
    f"""{CELLS}, slots as (select slot, cast(sum(n) as bigint) as slot_n from grid group by slot), g as (select cast(sum(slot_n) as bigint) as n_all, cast(sum(case when slot in (0, 1, 5) then slot_n else 0 end) as bigint) as night, cast(sum(case when slot = 2 then slot_n else 0 end) as bigint) as morning from slots),
    q as (select cast(floor(100.0 * night / n_all + 0.5) as bigint) as night_pct, cast(floor(100.0 * morning / n_all + 0.5) as bigint) as morning_pct from g)
    select (select max(n) from grid) as max_cell, night_pct, morning_pct, 100 - night_pct - morning_pct as day_pct, (select slot from slots order by slot_n desc, slot limit 1) as peak_slot from q""",
)
def a21_summary(s, d):
    return rollups.heatmap_summary(rollups.heatmap(v.commits(s, d)))


@query("a22_commit_timeline", f"with {v.COMMITS} select strftime(committed_at, '%b %-d') as label, count(*) as n, substr(min_by(full_sha, event_id), 1, 7) as first_sha from commits group by 1")
def a22(s, d):
    return v.commits(s, d).groupBy(F.date_format("at", "MMM d").alias("label")).agg(F.count("*").alias("n"), F.substring(F.min_by("full_sha", "event_id"), 1, 7).alias("first_sha"))


@query("a23_report_totals", f"{W}, files as (select path, count(*) filter (level = 'error') as confirmed, count(*) filter (k % 3 > 0) as exceptions, count(*) as leaks from findings where k % 2 = 0 group by path) select p.path, coalesce(leaks, 0) as leaks, coalesce(confirmed, 0) as confirmed, coalesce(exceptions, 0) as exceptions, case when coalesce(leaks, 0) = 0 then 'clean' else 'leaky' end as status from (select distinct path from findings) p left join files using (path)")
def a23(s, d):
    f = v.findings(s, d)
    g = f.where("k % 2 = 0").groupBy("path").agg(F.count("*").alias("leaks"), F.count_if(F.col("level") == "error").alias("confirmed"), F.count_if(F.col("k") % 3 > 0).alias("exceptions"))
    z = {c: F.coalesce(c, F.lit(0)) for c in ("leaks", "confirmed", "exceptions")}
    return f.select("path").distinct().join(g, "path", "left").withColumns(z).withColumn("status", F.when(F.col("leaks") == 0, "clean").otherwise("leaky"))


@query("a24_scan_log", f"{W} select login, repo, source, {LEVELS} from findings group by login, repo, source")
def a24(s, d):
    return merge.scan_log(v.findings(s, d), ["login", "repo", "source"])


@query("a27_graph_metrics", "with e as (select event_id as id, cast(floor((event_id - 1) / 2) as bigint) as parent, cast(floor(log2(event_id + 1)) as integer) as depth from events), n as (select count(*) as nodes, max(depth) + 1 as depth from e), w as (select max(c) as widest from (select count(*) as c from e group by depth)), f as (select max(c) as fan_out from (select count(*) as c from e where id > 0 group by parent)) select nodes, depth, widest, fan_out from n, w, f")
def a27(s, d):
    e = v.table(s, d, "events").select(F.col("event_id").alias("id"), F.floor((F.col("event_id") - 1) / 2).alias("parent"), F.floor(F.log2(F.col("event_id") + 1)).cast("int").alias("depth"))
    wide = e.groupBy("depth").agg(F.count("*").alias("c")).agg(F.max("c").alias("widest"))
    fan = e.where("id > 0").groupBy("parent").agg(F.count("*").alias("c")).agg(F.max("c").alias("fan_out"))
    return e.agg(F.count("*").alias("nodes"), (F.max("depth") + 1).alias("depth")).crossJoin(F.broadcast(wide)).crossJoin(F.broadcast(fan))


@query("a29_trace_total", "select user_id, sum(value) as duration_ms from events group by user_id")
def a29(s, d):
    return v.table(s, d, "events").groupBy("user_id").agg(F.sum("value").alias("duration_ms"))


@query("a30_distinct_names", f"{W} select distinct 'branch' as kind, branch as name from findings union all select distinct 'repo', repo from findings")
def a30(s, d):
    f = v.findings(s, d)
    return f.select(F.lit("branch").alias("kind"), F.col("branch").alias("name")).distinct().unionAll(f.select(F.lit("repo"), "repo").distinct()).orderBy("kind", "name")


@query("w3_latest_by_fingerprint", f"{W}, u as (select *, case when event_id % 2 = 0 then 0 else 1 end as list_no, {v.FINGERPRINT} as _id from findings) select _id, event_id, level, found_at from (select *, row_number() over (partition by _id order by found_at desc, list_no desc, event_id desc) as n from u) where n = 1")
def w3(s, d):
    f = v.findings(s, d)
    return merge.latest([f.where("event_id % 2 = 0"), f.where("event_id % 2 = 1")]).select("_id", "event_id", "level", "found_at")


RULE = "case event_id % 9 when 0 then 'open' when 1 then 'tempfile' when 2 then 'socket' when 3 then 'db-connect' when 4 then 'http-client' when 5 then 'process' when 6 then 'aliased-connect' else 'other' end"
ORDER = "case rule when 'open' then 0 when 'tempfile' then 1 when 'socket' then 2 when 'db-connect' then 3 when 'http-client' then 4 when 'process' then 5 when 'aliased-connect' then 6 else 7 end"


@query("w1_best_rule_per_line", f"{W}, t as (select *, {RULE} as rule from findings) select repo, path, line, rule, event_id from (select *, row_number() over (partition by repo, path, line order by {ORDER}, event_id) as n from t) where n = 1")
def w1(s, d):
    t = v.findings(s, d).withColumn("rule", F.expr(RULE))
    return merge.first_by(t, ["repo", "path", "line"], F.expr(ORDER), F.asc("event_id")).select("repo", "path", "line", "rule", "event_id")


TOOL = "case event_id % 3 when 0 then 'pattern' when 1 then 'linter' else 'syntactic' end"


@query("w2_first_tool_per_line", f"{W}, t as (select *, {TOOL} as tool from findings) select repo, path, line, tool, event_id from (select *, row_number() over (partition by repo, path, line order by case tool when 'pattern' then 0 when 'linter' then 1 else 2 end, event_id) as n from t) where n = 1")
def w2(s, d):
    t = v.findings(s, d).withColumn("tool", F.expr(TOOL))
    rank = F.when(F.col("tool") == "pattern", 0).when(F.col("tool") == "linter", 1).otherwise(2)
    return merge.first_by(t, ["repo", "path", "line"], rank.asc(), F.asc("event_id")).select("repo", "path", "line", "tool", "event_id")


@query("w4_first_run_per_sha", f"with {v.RUNS}, few as (select * from (select *, row_number() over (partition by repo order by created_at desc, run_id) as r from workflow_runs) where r <= 8) select repo, head_sha, run_id from (select *, row_number() over (partition by repo, head_sha order by r) as n from few) where n = 1")
def w4(s, d):
    few = v.workflow_runs(s, d).withColumn("r", F.expr("row_number() over (partition by repo order by created_at desc, run_id)")).where("r <= 8")
    return merge.first_by(few, ["repo", "head_sha"], F.asc("r")).select("repo", "head_sha", "run_id")


@query("w7_rank_bars", f"{W}, g as (select branch as key, {LEVELS} from findings group by branch order by error desc, total desc, key limit 7) select key, '#' || row_number() over (order by error desc, total desc, key) as rank, greatest(6.0, least(100.0, total * 100.0 / max(total) over ()))::double as width from g")
def w7(s, d):
    g = rollups.ranked(v.findings(s, d), "branch", F.col("branch"), 7)
    return rollups.with_rank(g, F.desc("error"), F.desc("total"), F.asc("key")).select("key", "rank", F.col("width").cast("double").alias("width"))


@query("w9_last_contract_per_key", "with c as (select p_brand as library, p_type as function, p_name as reason, p_partkey from part) select library, function, reason from (select *, row_number() over (partition by library, function order by p_partkey desc) as n from c) where n = 1")
def w9(s, d):
    c = v.table(s, d, "part").select(F.col("p_brand").alias("library"), F.col("p_type").alias("function"), F.col("p_name").alias("reason"), "p_partkey")
    return merge.first_by(c, ["library", "function"], F.desc("p_partkey")).select("library", "function", "reason")


@query("w10_first_error_per_key", "with e as (select event_id, 400 + user_id % 5 as status, event_type as message from events where event_type = 'error' or user_id % 3 = 0) select status || ':' || message as key, min(event_id) as event_id from e group by 1")
def w10(s, d):
    e = v.table(s, d, "events").where("event_type = 'error' or user_id % 3 = 0").select("event_id", F.concat((400 + F.col("user_id") % 5).cast("string"), F.lit(":"), F.col("event_type")).alias("key"))
    return e.groupBy("key").agg(F.min("event_id").alias("event_id"))


@query("w12_straight_line_liveness", "with e as (select user_id, event_id, case when event_type in ('click', 'view') then 'acquire' when event_type = 'error' then 'use' else 'release' end as op from events), n as (select *, lead(op) over (partition by user_id order by event_id) as next_op from e where op <> 'use') select user_id, event_id, case next_op when 'acquire' then 'reassignment' when 'release' then 'released' else 'exit' end as outcome from n where op = 'acquire'")
def w12(s, d):
    op = F.when(F.col("event_type").isin("click", "view"), "acquire").when(F.col("event_type") == "error", "use").otherwise("release")
    e = v.table(s, d, "events").select("user_id", "event_id", op.alias("op")).where("op <> 'use'")
    n = e.withColumn("next_op", F.expr("lead(op) over (partition by user_id order by event_id)")).where("op = 'acquire'")
    return n.select("user_id", "event_id", F.when(F.col("next_op") == "acquire", "reassignment").when(F.col("next_op") == "release", "released").otherwise("exit").alias("outcome"))


@query("p1_filter_findings", f"{W} select event_id, path, func from findings where level = 'error' and branch = 'main' and contains(lower(concat_ws(' ', path, message, title, coalesce(func, ''), branch)), lower(trim(' F3 '))) ")
def p1(s, d):
    f = v.findings(s, d).where("level = 'error' and branch = 'main'")
    hay = F.concat_ws(" ", "path", "message", "title", F.coalesce("func", F.lit("")), "branch")
    return trigrams.build(f, "event_id", {"all": hay}).search([[("all", " F3 ".strip())]]).select("event_id", "path", "func")


@query("p1_scanned_findings", f"{W} select event_id, path, func from findings where level = 'error' and branch = 'main' and contains(lower(concat_ws(' ', path, message, title, coalesce(func, ''), branch)), 'f12') ")
def p1_scan(s, d):
    return predicates.filter_findings(v.findings(s, d), level="error", branch="main", text=" F12 ").select("event_id", "path", "func")


@query("p2_relevant_annotations", f"{W} select event_id from findings where contains(lower(title || ' ' || message), 'resource leak in f1') or contains(lower(title || ' ' || message), 'purchase is never closed')")
def p2(s, d):
    return v.findings(s, d).where(predicates.mentions(["resource leak in f1", "purchase is never closed"], "title", "message")).select("event_id")


@query("p3_named_or_all", f"with {v.RUNS}, m as (select *, contains(lower(name), 'leak check') as named, max(contains(lower(name), 'leak check')) over (partition by head_sha) as any_named from workflow_runs) select run_id, head_sha, name from m where named or not any_named")
def p3(s, d):
    return predicates.named_or_all(v.workflow_runs(s, d), F.lower("name").contains("leak check"), "head_sha").select("run_id", "head_sha", "name")


@query("p4_level_mapping", "select event_id, case event_type when 'error' then 'error' when 'click' then 'warning' else 'notice' end as level from events")
def p4(s, d):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    return v.table(s, d, "events").select("event_id", predicates.level_of(kind).alias("level"))


@query("p5_live_kind_mapping", f"{W} select event_id, case when k % 3 = 1 then 'warning' else 'error' end as level, coalesce(nullif(k % 4, 0), line) as line from findings where source = 'live'")
def p5(s, d):
    kind = F.when(F.col("k") % 3 == 1, "exception").otherwise("path")
    return v.findings(s, d).where("source = 'live'").select("event_id", F.when(kind == "exception", "warning").otherwise("error").alias("level"), F.coalesce(F.expr("nullif(k % 4, 0)"), "line").alias("line"))


@query("p6_function_from_title", f"{W} select event_id, nullif(regexp_extract(title, 'in\\s+([A-Za-z_][A-Za-z0-9_]*)\\(\\)', 1), '') as func from findings")
def p6(s, d):
    return v.findings(s, d).select("event_id", predicates.func_from_title("title").alias("func"))


ACQ = "case p_partkey % 9 when 0 then 'socket.socket' when 1 then 'sqlite3.connect' when 2 then 'requests.Session' when 3 then 'subprocess.Popen' when 4 then 'tempfile.TemporaryFile' when 5 then 'pymongo.MongoClient' when 6 then 'httpx.Client' when 7 then 'redis.Redis' else 'open' end"


@query("p7_resource_category", f"select p_partkey, case when contains(a, 'socket') then 'socket' when regexp_matches(a, 'sqlite|psycopg|mysql|pymongo|mongo') then 'database' when regexp_matches(a, 'requests|httpx') then 'http' when regexp_matches(a, 'Popen|Process|subprocess|multiprocessing') then 'process' when contains(a, 'tempfile') then 'tempfile' else 'file' end as category from (select p_partkey, {ACQ} as a from part)")
def p7(s, d):
    return v.table(s, d, "part").select("p_partkey", F.expr(f"{ACQ} as a")).select("p_partkey", predicates.resource_category("a").alias("category"))


@query("p13_ci_gating", f"{W} select event_id, level = 'error' as blocks from findings")
def p13(s, d):
    return v.findings(s, d).select("event_id", (F.col("level") == "error").alias("blocks"))


@query("p14_eligible_files", f"with {v.FILES} select path, size from repo_files where type = 'blob' and ends_with(lower(path), '.py') and size > 0 and size < 200000 order by path limit 30")
def p14(s, d):
    return predicates.eligible(v.repo_files(s, d), 200_000, 30).select("path", "size")


@query("p15_risk_label", f"{W}, g as (select repo, count(*) filter (level = 'error' and k % 9 = 0) as confirmed, count(*) filter (k % 4 = 0) as total from findings group by repo) select repo, case when total = 0 then 'CLEAN' when confirmed > 3 then 'CRITICAL' when confirmed > 0 then 'HIGH' else 'MEDIUM' end as risk from g")
def p15(s, d):
    g = v.findings(s, d).groupBy("repo").agg(F.count_if((F.col("level") == "error") & (F.col("k") % 9 == 0)).alias("confirmed"), F.count_if(F.col("k") % 4 == 0).alias("total"))
    return g.select("repo", predicates.risk("confirmed", "total").alias("risk"))


@query("p16_rule_search", "select p_partkey, p_name from part where contains(lower(p_type), 'eco') and (contains(lower(p_name), 'widget') or contains(lower(p_brand), 'widget'))")
def p16(s, d):
    index = trigrams.build(v.table(s, d, "part"), "p_partkey", {c: F.col(c) for c in ("p_type", "p_name", "p_brand")})
    return index.search([[("p_type", "eco")], [("p_name", "widget"), ("p_brand", "widget")]]).select("p_partkey", "p_name")


@query("p17_commit_search", f"with {v.COMMITS} select event_id from commits where contains(lower(coalesce(message, '')), 'ab1') or contains(full_sha, 'ab1') or contains(lower(coalesce(author, '')), 'ab1')")
def p17(s, d):
    index = trigrams.build(v.commits(s, d), "event_id", {c: F.col(c) for c in ("message", "full_sha", "author")})
    return index.search([[(c, "ab1") for c in index.fields]]).select("event_id")


@query("p18_file_search", f"with {v.FILES} select path from repo_files where contains(lower(path), 'red') order by path limit 300")
def p18(s, d):
    index = trigrams.build(v.repo_files(s, d).select("p_partkey", "path"), "p_partkey", {"path": F.col("path")})
    return index.search([[("path", "red")]]).orderBy("path").limit(300).select("path")


KEY = "case c_custkey % 6 when 0 then 'TEAM-1' when 1 then 'x-business' when 2 then 'enterprise' when 3 then 'business-ent' when 4 then '' else 'free' end"


@query("p19_license_plan", f"select c_custkey, case when contains(k, 'team') then 'team' when contains(k, 'business') then 'business' when contains(k, 'ent') then 'enterprise' else 'community' end as plan from (select c_custkey, lower({KEY}) as k from customer)")
def p19(s, d):
    return v.table(s, d, "customer").select("c_custkey", predicates.plan(F.expr(KEY)).alias("plan"))


URL = "case c_custkey % 4 when 0 then 'https://host.example/org/' || c_custkey || '.git' when 1 then 'org/' || c_custkey || '/' when 2 then 'single' else ' http://host.example/a/b ' end"


@query("p20_repo_reference", f"with u as (select c_custkey, string_split(trim(regexp_replace(regexp_replace(trim({URL}), '^https?://[^/]+/', ''), '\\.git$', ''), '/'), '/') as p from customer) select c_custkey, case when len(p) >= 2 then p[1] end as owner, case when len(p) >= 2 then p[2] end as repo from u")
def p20(s, d):
    return predicates.repo_reference(v.table(s, d, "customer").select("c_custkey", F.expr(f"{URL} as raw")), "raw").select("c_custkey", "owner", "repo")


SECS = f"greatest(0, cast(floor(epoch(timestamp '{v.AS_OF}') - epoch(ts)) as bigint))"


@query(
    "p21_relative_time",
    f"""with t as (select event_id, {SECS} as s from events) select event_id, case when s is null then '-' when s < 45 then 'just now' when s < 60 then s || 's ago' when s // 60 < 60 then (s // 60) || 'm ago' when s // 3600 < 24 then (s // 3600) || 'h ago'
    when s // 86400 < 30 then (s // 86400) || 'd ago' when s // 86400 // 30 < 12 then (s // 86400 // 30) || 'mo ago' else (s // 86400 // 30 // 12) || 'y ago' end as label from t""",
)
def p21(s, d):
    return v.table(s, d, "events").select("event_id", predicates.time_ago("ts", v.AS_OF).alias("label"))


@query("p22_labels", f"with {v.RUNS} select run_id, case when status <> 'completed' then replace(status, '_', ' ') else coalesce(conclusion, 'unknown') end as conclusion_label, case when event = 'pull_request' then case when run_id % 2 = 0 then 'PR #' || run_id else 'pull request' end when event = 'scan' then 'on-demand scan' else replace(event, '_', ' ') end as event_label from workflow_runs")
def p22(s, d):
    prs = F.when(F.col("run_id") % 2 == 0, F.array("run_id")).otherwise(F.array().cast("array<bigint>"))
    return v.workflow_runs(s, d).select("run_id", predicates.conclusion_label("status", "conclusion").alias("conclusion_label"), predicates.event_label("event", prs).alias("event_label"))


@query("o1_stored_findings_page", f"{W} select event_id, found_at from findings where level = 'error' order by found_at desc, event_id desc limit 2000")
def o1(s, d):
    return rollups.top(v.findings(s, d).where("level = 'error'"), min(5000, 2000), F.desc("found_at"), F.desc("event_id")).select("event_id", "found_at")


@query("s18_finding_scan", f"{W} select event_id, repo, branch, found_at from findings where login = 'org3' and source = 'ci' and level = 'error' order by found_at desc, event_id desc limit 500")
def s18(s, d):
    return predicates.stored(v.findings(s, d), {"login": "ORG3", "source": "ci", "level": "error"}).select("event_id", "repo", "branch", "found_at")


@query("s19_scan_history", f"with {v.RUNS} select run_id, created_at from workflow_runs where repo = 'org2/repo2' or repo = 'org3/repo3' order by created_at desc, run_id limit 50")
def s19(s, d):
    return rollups.top(v.workflow_runs(s, d).where(F.col("repo").isin("org2/repo2", "org3/repo3")), 50, F.desc("created_at"), F.asc("run_id")).select("run_id", "created_at")


@query("s20_accounts", f"with {v.ACCOUNTS} select account_id, login, added_no from accounts order by added_no")
def s20(s, d):
    return v.accounts(s, d).select("account_id", "login", "added_no").orderBy("added_no")


@query("o4_rows_per_group", f"{W} select repo, event_id from (select repo, event_id, row_number() over (partition by repo order by found_at desc, event_id desc) as n from findings) where n <= 25")
def o4(s, d):
    return v.findings(s, d).withColumn("n", F.expr("row_number() over (partition by repo order by found_at desc, event_id desc)")).where("n <= 25").select("repo", "event_id")


@query("o5_first_runs", f"with {v.RUNS} select run_id from workflow_runs order by created_at desc, run_id limit 8")
def o5(s, d):
    return rollups.top(v.workflow_runs(s, d), 8, F.desc("created_at"), F.asc("run_id")).select("run_id")
