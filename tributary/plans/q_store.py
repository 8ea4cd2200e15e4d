"""Queries of the findings store, joins, sources, contracts and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import contracts, graphs, intervals, merge
from tributary.plans import views as v
from tributary.plans.base import query
from tributary.sources import records

W = "with " + v.FINDINGS
FP = v.FINGERPRINT
STORED = f"stored as (select {FP} as _id, min_by(level, event_id) as level, min_by(title, event_id) as title, min(found_at) as first_seen, max(found_at) as last_seen, min(login) as login, min(repo) as repo, min(source) as source from findings where event_id % 2 = 0 group by 1)"
BATCH = f"batch as (select {FP} as _id, max_by(level, event_id) as level, max_by(title, event_id) as title, min(login) as login, min(repo) as repo, min(source) as source from findings where event_id % 2 = 1 and k % 4 > 0 group by 1)"


def stored(s, d):
    f = v.findings(s, d).where("event_id % 2 = 0").withColumn("_id", merge.fingerprint())
    return f.groupBy("_id").agg(F.min_by("level", "event_id").alias("level"), F.min_by("title", "event_id").alias("title"), F.min("found_at").alias("first_seen"), F.max("found_at").alias("last_seen"), F.min("login").alias("login"), F.min("repo").alias("repo"), F.min("source").alias("source"))


def batch(s, d):
    f = v.findings(s, d).where("event_id % 2 = 1 and k % 4 > 0").withColumn("_id", merge.fingerprint())
    return f.groupBy("_id").agg(F.max_by("level", "event_id").alias("level"), F.max_by("title", "event_id").alias("title"), F.min("login").alias("login"), F.min("repo").alias("repo"), F.min("source").alias("source"))


NOW = f"timestamp '{v.AS_OF}'"


@query("k6_upsert", f"{W}, {STORED}, {BATCH} select _id, coalesce(b.level, s.level) as level, coalesce(b.title, s.title) as title, coalesce(s.first_seen, {NOW}) as first_seen, case when b._id is not null then {NOW} else s.last_seen end as last_seen from stored s full outer join batch b using (_id)")
def k6(s, d):
    return merge.upsert(stored(s, d).drop("login", "repo", "source"), batch(s, d), v.AS_OF)


@query("k7_replace_scope", f"{W}, {STORED}, {BATCH} select _id from stored s where not exists (select 1 from batch b where b.login = s.login and b.repo = s.repo and b.source = s.source) or _id in (select _id from batch)")
def k7(s, d):
    return merge.replace_scope(stored(s, d), batch(s, d), ["login", "repo", "source"]).select("_id")


@query("k8_append_scan_log", f"{W} select login, repo, source, count(*) filter (level = 'error') as error, count(*) filter (level = 'warning') as warning, count(*) filter (level = 'notice') as notice, count(*) as total from findings where event_id % 2 = 1 group by login, repo, source")
def k8(s, d):
    return merge.scan_log(v.findings(s, d).where("event_id % 2 = 1"), ["login", "repo", "source"])


@query("k9_account_upsert", f"with {v.ACCOUNTS}, o as (select * from accounts where added_no % 2 = 0), n as (select account_id, login, added_no + 1000000 as added_no from accounts where added_no % 3 = 0) select account_id, coalesce(n.login, o.login) as login, coalesce(o.added_no, n.added_no) as added_no from o full outer join n using (account_id)")
def k9(s, d):
    a = v.accounts(s, d)
    new = a.where("added_no % 3 = 0").select("account_id", F.col("login").alias("n_login"), (F.col("added_no") + 1000000).alias("n_added"))
    return a.where("added_no % 2 = 0").join(new, "account_id", "full_outer").select("account_id", F.coalesce("n_login", "login").alias("login"), F.coalesce("added_no", "n_added").alias("added_no"))


@query("k9_delete_cascade", f"{W} select count(*) filter (login = 'org3') as dropped, count(*) filter (login <> 'org3') as kept from findings")
def k9_delete(s, d):
    f = v.findings(s, d)
    gone = s.createDataFrame([("org3",)], "login string")
    kept = f.join(gone, "login", "left_anti").agg(F.count("*").alias("kept"))
    return f.join(gone, "login", "left_semi").agg(F.count("*").alias("dropped")).crossJoin(F.broadcast(kept))


@query("k10_contract_upsert", "with c as (select p_brand as library, p_type as function, p_name as reason, p_partkey as arrival from part) select library, function, max_by(reason, arrival) as reason from c group by library, function")
def k10(s, d):
    c = v.table(s, d, "part").select(F.col("p_brand").alias("library"), F.col("p_type").alias("function"), F.col("p_name").alias("reason"), F.col("p_partkey").alias("arrival"))
    return c.groupBy("library", "function").agg(F.max_by("reason", "arrival").alias("reason"))


ESC = "replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"


def escaped(c):
    out = F.replace(c, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


@query("k3_ci_annotations", f"{W} select event_id, '::' || case when level = 'error' then 'error' else 'warning' end || ' file=' || path || ',line=' || line || ',title=' || {ESC.format('title')} || '::' || {ESC.format('message')} as line from findings")
def k3(s, d):
    level = F.when(F.col("level") == "error", "error").otherwise("warning")
    line = F.concat(F.lit("::"), level, F.lit(" file="), "path", F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), escaped(F.col("title")), F.lit("::"), escaped(F.col("message")))
    return v.findings(s, d).select("event_id", line.alias("line"))


@query("k4_step_summary", f"{W} select repo, '| ' || repo || ' | ' || count(*) || ' | ' || count(*) filter (level = 'error') || ' |' as row from findings group by repo")
def k4(s, d):
    g = v.findings(s, d).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("e"))
    return g.select("repo", F.concat(F.lit("| "), "repo", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("e").cast("string"), F.lit(" |")).alias("row"))


@query("k14_exit_verdict", f"{W}, {v.RUNS}, r as (select distinct repo from workflow_runs union select repo from findings), g as (select repo, bool_or(level = 'error') as definite from findings where line > 90 group by repo) select repo, definite is not null as any_finding, coalesce(definite, false) as definite from r left join g using (repo)")
def k14(s, d):
    """Whether a repository's run has any finding behind line 90, and any definite one; runs without findings succeed."""
    f = v.findings(s, d)
    repos = v.workflow_runs(s, d).select("repo").union(f.select("repo")).distinct()
    g = f.where("line > 90").groupBy("repo").agg(F.bool_or(F.col("level") == "error").alias("definite"))
    return repos.join(g, "repo", "left").select("repo", F.col("definite").isNotNull().alias("any_finding"), F.coalesce("definite", F.lit(False)).alias("definite"))


@query("u1_union_of_sources", f"{W} select event_id, source from findings where source = 'ci' union all select event_id, source from findings where source = 'live'")
def u1(s, d):
    f = v.findings(s, d).select("event_id", "source")
    return f.where("source = 'ci'").unionByName(f.where("source = 'live'"))


@query("u2_distinct_union", f"{W} select {FP} as _id, max(found_at) as found_at from findings group by 1")
def u2(s, d):
    f = v.findings(s, d)
    return merge.latest([f.where("source = 'ci'"), f.where("source = 'live'")]).select("_id", "found_at")


@query("u3_new_identities", f"{W} select distinct {FP} as _id from findings where event_id % 2 = 1 except select {FP} from findings where event_id % 2 = 0")
def u3(s, d):
    f = v.findings(s, d).withColumn("_id", merge.fingerprint())
    return f.where("event_id % 2 = 1").select("_id").distinct().join(f.where("event_id % 2 = 0").select("_id"), "_id", "left_anti")


@query("u5_blocks_with_leak", f"{W}, b as (select path, list(distinct line) as blocks, list(distinct line) filter (level = 'error' and k % 7 = 0) as leak from findings group by path) select path, coalesce(list_has_any(blocks, leak), false) as has_leak from b")
def u5(s, d):
    f = v.findings(s, d)
    leak = f.where("level = 'error' and k % 7 = 0").select("path", "line").distinct()
    hit = f.select("path", "line").distinct().join(leak, ["path", "line"], "left_semi").select("path").distinct().withColumn("hit", F.lit(True))
    return f.select("path").distinct().join(hit, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("has_leak"))


@query("u6_replace_half", f"{W} select event_id, 'ci' as half from findings where source = 'ci' and event_id % 2 = 1 union all select event_id, 'live' from findings where source = 'live'")
def u6(s, d):
    f = v.findings(s, d)
    return f.where("source = 'ci' and event_id % 2 = 1").select("event_id", F.lit("ci").alias("half")).unionByName(f.where("source = 'live'").select("event_id", F.lit("live").alias("half")))


@query("j5_tool_finding_first_leak", f"{W}, l as (select repo, path, line, min_by(level, event_id) as level from findings where event_id % 2 = 0 group by 1, 2, 3) select t.event_id, l.level as leak_level from (select * from findings where event_id % 2 = 1) t left join l using (repo, path, line)")
def j5(s, d):
    f = v.findings(s, d)
    leaks = f.where("event_id % 2 = 0").groupBy("repo", "path", "line").agg(F.min_by("level", "event_id").alias("leak_level"))
    return f.where("event_id % 2 = 1").join(leaks, ["repo", "path", "line"], "left").select("event_id", "leak_level")


@query("d28_ensemble_verdict", f"{W}, l as (select repo, path, line, min_by(k % 3, event_id) as kind from findings where event_id % 3 = 0 group by 1, 2, 3), a as (select distinct repo, path, line from findings where event_id % 3 = 1) select t.event_id, case when kind in (0, 2) then 'confirmed_path_leak' when kind = 1 then 'confirmed_exception_unsafe' when a.repo is not null then 'refuted_safe' else 'unverified' end as verdict from (select * from findings where event_id % 3 = 2) t left join l using (repo, path, line) left join a using (repo, path, line)")
def d28(s, d):
    f, at = v.findings(s, d), ["repo", "path", "line"]
    leaks = f.where("event_id % 3 = 0").groupBy(*at).agg(F.min_by(F.col("k") % 3, "event_id").alias("kind"))
    acquires = f.where("event_id % 3 = 1").select(*at).distinct().withColumn("analyzed", F.lit(True))
    verdict = F.when(F.col("kind").isin(0, 2), "confirmed_path_leak").when(F.col("kind") == 1, "confirmed_exception_unsafe").when(F.col("analyzed"), "refuted_safe").otherwise("unverified")
    return f.where("event_id % 3 = 2").join(leaks, at, "left").join(acquires, at, "left").select("event_id", verdict.alias("verdict"))


@query("j6_analyzed_lines", f"{W} select event_id from findings t where event_id % 2 = 1 and exists (select 1 from findings a where a.event_id % 2 = 0 and a.repo = t.repo and a.path = t.path and a.line = t.line)")
def j6(s, d):
    f = v.findings(s, d)
    return f.where("event_id % 2 = 1").join(f.where("event_id % 2 = 0").select("repo", "path", "line"), ["repo", "path", "line"], "left_semi").select("event_id")


REGIONS = "regions as (select repo, path, min(line) as s, min(line) + 3 as e from findings where source = 'live' group by 1, 2)"


@query("j7_outside_safe_regions", f"{W}, {REGIONS} select event_id from findings f where source = 'ci' and not exists (select 1 from regions r where r.repo = f.repo and r.path = f.path and f.line between r.s and r.e)")
def j7(s, d):
    f = v.findings(s, d)
    r = f.where("source = 'live'").groupBy("repo", "path").agg(F.min("line").alias("s"), (F.min("line") + 3).alias("e"))
    return intervals.outside(f.where("source = 'ci'").select("event_id", "repo", "path", "line"), r, ["repo", "path"], "line", "s", "e").select("event_id")


FUNCS = "funcs as (select repo as unit, func, min(line) as f1, max(line) as f2 from findings where level = 'error' group by 1, 2), pts as (select distinct repo as unit, line from findings where source = 'live')"


@query("j8_enclosing_function", f"{W}, {FUNCS} select p.unit, p.line, min_by(func, {{'w': f2 - f1, 'f': func}}) as func from pts p left join funcs f on f.unit = p.unit and p.line between f1 and f2 group by 1, 2")
def j8(s, d):
    f = v.findings(s, d).withColumnRenamed("repo", "unit")
    funcs = f.where("level = 'error'").groupBy("unit", "func").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return graphs.enclosing(f.where("source = 'live'").select("unit", "line").distinct(), funcs)


@query("j11_expired_ids", f"{W} select distinct {FP} as _id from findings where event_id % 2 = 0 and {FP} not in (select {FP} from findings where event_id % 2 = 1)")
def j11(s, d):
    f = v.findings(s, d).withColumn("_id", merge.fingerprint())
    return f.where("event_id % 2 = 0").select("_id").distinct().join(f.where("event_id % 2 = 1").select("_id"), "_id", "left_anti")


@query("j13_account_repositories", f"{W}, {v.ACCOUNTS} select distinct repo from findings where login in (select org from accounts where repo_count > 20)")
def j13(s, d):
    a = v.accounts(s, d).where("repo_count > 20").select(F.col("org").alias("login"))
    return v.findings(s, d).join(a, "login", "left_semi").select("repo").distinct()


@query("j14_new_contracts", "select distinct p_brand as library, p_type as function from part where p_partkey % 2 = 1 and (p_brand, p_type) not in (select (p_brand, p_type) from part where p_partkey % 2 = 0)")
def j14(s, d):
    c = v.table(s, d, "part").select(F.col("p_brand").alias("library"), F.col("p_type").alias("function"), "p_partkey")
    return c.where("p_partkey % 2 = 1").select("library", "function").distinct().join(c.where("p_partkey % 2 = 0"), ["library", "function"], "left_anti")


@query("j15_new_definite", f"{W} select repo, path, line from findings where level = 'error' and event_id % 2 = 1 except all select repo, path, line from findings where level = 'error' and event_id % 2 = 0")
def j15(s, d):
    f = v.findings(s, d).where("level = 'error'")
    return f.where("event_id % 2 = 1").select("repo", "path", "line").exceptAll(f.where("event_id % 2 = 0").select("repo", "path", "line"))


@query("j16_unknown_logins", "select c_custkey, upper(c_name) as login from customer where c_custkey % 3 = 0 and lower(upper(c_name)) not in (select lower(c_name) from customer where c_custkey % 2 = 0)")
def j16(s, d):
    c = v.table(s, d, "customer")
    known = c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("id"))
    asked = c.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("login")).withColumn("id", F.lower("login"))
    return asked.join(known, "id", "left_anti").select("c_custkey", "login")


@query("j17_runs_checks_annotations", "select o.o_orderkey as run_id, l.l_linenumber as check_id, p.p_partkey as annotation_id from orders o join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey where o.o_orderstatus = 'F' and p.p_size < 5")
def j17(s, d):
    o = v.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    li = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("check_id"), F.col("l_partkey").alias("annotation_id"))
    p = v.table(s, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("annotation_id"))
    return li.join(o, "run_id").join(p, "annotation_id").select("run_id", "check_id", "annotation_id")


CALLS = "calls as (select event_id, user_id % 5 as unit, case event_id % 6 when 0 then 'db.connect' when 1 then 'open' when 2 then 'sock.socket' when 3 then 'a.b.open' when 4 then 'connect' else 'helper' end as call_name from events)"


def calls(s, d):
    n = F.col("event_id") % 6
    name = F.when(n == 0, "db.connect").when(n == 1, "open").when(n == 2, "sock.socket").when(n == 3, "a.b.open").when(n == 4, "connect").otherwise("helper")
    return v.table(s, d, "events").select("event_id", (F.col("user_id") % 5).alias("unit"), name.alias("call_name"))


IMPORTS = "imports(unit, local, canonical) as (values (0, 'db', 'sqlite3'), (1, 'db', 'psycopg2'), (2, 'sock', 'socket'), (3, 'connect', 'sqlite3.connect'))"
SPECS = "specs(pos, acquire, release) as (values (0, 'open', 'close'), (1, 'socket.socket', 'close'), (2, 'sqlite3.connect', 'close'), (3, 'psycopg2.connect', 'disconnect'))"
RESOLVED = "resolved as (select event_id, c.unit, call_name, case when canonical is null then call_name else canonical || substr(call_name, length(local) + 1) end as resolved from calls c left join imports i on i.unit = c.unit and i.local = string_split(call_name, '.')[1])"


def imports(s):
    return s.createDataFrame([(0, "db", "sqlite3"), (1, "db", "psycopg2"), (2, "sock", "socket"), (3, "connect", "sqlite3.connect")], "unit bigint, local string, canonical string")


def specs(s):
    return s.createDataFrame([(0, "open", "close"), (1, "socket.socket", "close"), (2, "sqlite3.connect", "close"), (3, "psycopg2.connect", "disconnect")], "pos int, acquire string, release string")


@query("p9_resolved_call_names", f"with {CALLS}, {IMPORTS}, {RESOLVED} select event_id, resolved from resolved")
def p9(s, d):
    return contracts.canonical(calls(s, d), imports(s)).select("event_id", "resolved")


@query("j1_import_join", f"with {CALLS}, {IMPORTS} select event_id, canonical from calls c left join imports i on i.unit = c.unit and i.local = string_split(call_name, '.')[1]")
def j1(s, d):
    i = imports(s).withColumnRenamed("local", "head")
    return calls(s, d).withColumn("head", F.get(F.split("call_name", r"\."), 0)).join(i, ["unit", "head"], "left").select("event_id", "canonical")


HITS = "resolved = acquire or ends_with(resolved, '.' || acquire) or ends_with(acquire, '.' || resolved)"


@query("j2_first_matching_spec", f"with {CALLS}, {IMPORTS}, {SPECS}, {RESOLVED} select event_id, resolved, min_by(acquire, pos) as acquire, min_by(release, pos) as release from resolved, specs where {HITS} group by 1, 2")
def j2(s, d):
    r = contracts.canonical(calls(s, d), imports(s)).select("event_id", "resolved")
    return contracts.matched(r, specs(s))


@query("p8_matching_specs", f"with {CALLS}, {IMPORTS}, {SPECS}, {RESOLVED} select event_id, count(*) as specs from resolved, specs where {HITS} group by 1")
def p8(s, d):
    r = contracts.canonical(calls(s, d), imports(s)).select("event_id", "resolved")
    return contracts.match_counts(r, specs(s)).select("event_id", "specs")


CON = "contracts(pos, library, function, behavior) as (values (0, 'builtins', 'open', 'CREATES_RESOURCE'), (1, 'db', 'connect', 'RETURNS_RESOURCE'), (2, 'db', 'connect', 'UNKNOWN'), (3, 'a.b', 'open', 'PRESERVES_INPUT'))"


def con(s):
    return s.createDataFrame([(0, "builtins", "open", "CREATES_RESOURCE"), (1, "db", "connect", "RETURNS_RESOURCE"), (2, "db", "connect", "UNKNOWN"), (3, "a.b", "open", "PRESERVES_INPUT")], "pos int, library string, function string, behavior string")


LOOK = f"with {CALLS}, {CON}, k as (select *, coalesce(nullif(regexp_extract(call_name, '^(.*)\\.[^.]+$', 1), ''), 'builtins') as library, string_split(call_name, '.')[-1] as function from calls), o as (select library, function, min_by(behavior, pos) as behavior from contracts group by 1, 2)"


@query("j3_contract_lookup", f"{LOOK} select event_id, library, function, coalesce(behavior, 'UNKNOWN') as behavior from k left join o using (library, function)")
def j3(s, d):
    return contracts.resolved(calls(s, d), con(s)).select("event_id", "library", "function", "behavior")


@query("d25_contract_resolution", f"{LOOK} select coalesce(behavior, 'UNKNOWN') as behavior, count(*) as calls from k left join o using (library, function) group by 1")
def d25(s, d):
    return contracts.resolved(calls(s, d), con(s)).groupBy("behavior").agg(F.count("*").alias("calls"))


@query("j18_acquire_contract_display", f"{LOOK} select event_id, coalesce(behavior, 'none') as contract from k left join o using (library, function)")
def j18(s, d):
    c = contracts.resolved(calls(s, d), con(s).where("behavior <> 'UNKNOWN'"))
    return c.select("event_id", F.when(F.col("behavior") == "UNKNOWN", "none").otherwise(F.col("behavior")).alias("contract"))


RAW = """raw as (select p_partkey, case p_partkey % 8 when 0 then '' when 1 then '9bad' else 'lib.f' || p_partkey end as function, case p_partkey % 5 when 0 then 'closes_input' when 1 then 'UNKNOWN | RETURNS_RESOURCE' when 2 then 'nonsense' else 'BORROW,PRESERVES_INPUT' end as behavior,
  case p_partkey % 3 when 0 then 'borrow' when 1 then 'x;TRANSFER' else '??' end as ownership, case when p_partkey % 2 = 0 then 'GUARANTEED' else 'perhaps' end as exception_safety, case p_partkey % 7 when 0 then 'abc' when 1 then '1.5' when 2 then '0.5' else '0.9' end as confidence from part)"""


def norm_sql(c, values):
    inside = ", ".join(f"'{x}'" for x in values)
    return f"case when upper(trim({c})) in ({inside}) then upper(trim({c})) else list_filter(regexp_split_to_array(upper(trim({c})), '[|/,;\\s]+'), lambda x: x in ({inside}))[1] end"


@query(
    "p11_contract_validation",
    f"""with {RAW}, n as (select *, {norm_sql('behavior', contracts.BEHAVIORS)} as b, {norm_sql('ownership', contracts.OWNERSHIPS)} as o, try_cast(confidence as double) as c from raw)
    select p_partkey, b as behavior_n, case when function = '' then 'missing function' when not regexp_matches(function, '^[a-zA-Z_][a-zA-Z0-9_\\.]*$') then 'bad identifier' when b is null then 'bad behavior' when o is null then 'bad ownership'
    when c is null or c < 0 or c > 1 then 'bad confidence' when c < 0.85 then 'low confidence' end as reason from n""",
)
def p11(s, d):
    k = F.col("p_partkey")
    pick = lambda m, vals, rest: __import__("functools").reduce(lambda w, x: w.when(k % m == x[0], x[1]), list(enumerate(vals))[1:], F.when(k % m == 0, vals[0])).otherwise(rest)
    raw = v.table(s, d, "part").select(
        "p_partkey",
        pick(8, ["", "9bad"], F.concat(F.lit("lib.f"), k.cast("string"))).alias("function"),
        pick(5, ["closes_input", "UNKNOWN | RETURNS_RESOURCE", "nonsense"], "BORROW,PRESERVES_INPUT").alias("behavior"),
        pick(3, ["borrow", "x;TRANSFER"], "??").alias("ownership"),
        pick(2, ["GUARANTEED"], "perhaps").alias("exception_safety"),
        pick(7, ["abc", "1.5", "0.5"], "0.9").alias("confidence"),
    )
    return contracts.validated(raw).select("p_partkey", "behavior_n", "reason")


@query("s6_changed_files", f"with {v.FILES}, a as (select * from repo_files where p_partkey % 2 = 0), b as (select path, case when p_partkey % 5 = 0 then md5(sha) else sha end as sha from repo_files where p_partkey % 4 < 3) select b.path from b where ends_with(lower(b.path), '.py') and not exists (select 1 from a where a.path = b.path and a.sha = b.sha)")
def s6(s, d):
    f = v.repo_files(s, d)
    after = f.where("p_partkey % 4 < 3").withColumn("sha", F.when(F.col("p_partkey") % 5 == 0, F.md5(F.col("sha").cast("binary"))).otherwise(F.col("sha")))
    return records.changed(f.where("p_partkey % 2 = 0"), after)


@query("s10_repo_tree", f"with {v.FILES} select path, size, sha from repo_files where type = 'blob' and ends_with(lower(path), '.py') order by path")
def s10(s, d):
    return records.tree(v.repo_files(s, d))


@query("s11_file_content", "select p_partkey, p_name || chr(10) || p_brand as content from part")
def s11(s, d):
    raw = F.base64(F.concat("p_name", F.lit("\n"), "p_brand").cast("binary"))
    broken = F.regexp_replace(raw, "(.{8})", "$1\n")
    return records.content(v.table(s, d, "part").select("p_partkey", broken.alias("encoded")), "encoded").select("p_partkey", "content")


@query("s13_commit_projection", f"with {v.COMMITS} select event_id, substr(full_sha, 1, 7) as sha, coalesce(message, 'Commit') as message, coalesce(author, committer, 'unknown') as author from commits")
def s13(s, d):
    return records.commits(v.commits(s, d))


@query("s14_workflow_run_projection", f"with {v.RUNS} select run_id, name, coalesce(head_branch, '(detached)') as branch, coalesce(conclusion, 'unknown') as conclusion, string_split(commit_message, chr(10))[1] as title, case when run_id % 2 = 0 then [cast(run_id % 100 as integer)] else [] end as pr_numbers from workflow_runs")
def s14(s, d):
    r = v.workflow_runs(s, d)
    prs = F.when(F.col("run_id") % 2 == 0, F.array(F.struct((F.col("run_id") % 100).cast("int").alias("number"))))
    body = F.to_json(F.struct(F.col("run_id").alias("id"), "name", "head_branch", "head_sha", "event", "status", "conclusion", F.struct(F.col("commit_message").alias("message")).alias("head_commit"), prs.alias("pull_requests")))
    return records.runs(r.select(body.alias("body")), "body")


@query("s15_check_runs", f"with {v.RUNS} select head_sha, count(*) as checks, min(run_id) as first_check from workflow_runs group by head_sha")
def s15(s, d):
    body = v.workflow_runs(s, d).select(F.to_json(F.struct(F.col("run_id").alias("id"), "head_sha")).alias("body"))
    r = body.select(F.from_json("body", "struct<id:bigint,head_sha:string>").alias("r")).select("r.*")
    return r.groupBy("head_sha").agg(F.count("*").alias("checks"), F.min("id").alias("first_check"))


@query("s16_annotations", f"{W} select event_id, path, cast(line as integer) as start_line, cast(line as integer) as end_line, case when level = 'error' then 'failure' else 'notice' end as level, title from findings")
def s16(s, d):
    f = v.findings(s, d)
    body = F.to_json(F.struct("path", F.col("line").alias("start_line"), F.when(F.col("level") == "error", "failure").alias("annotation_level"), "title", "message"))
    return records.annotations(f.select("event_id", body.alias("body")), "body", "event_id")


@query("s17_branches", f"with {v.RUNS} select head_branch as name, max_by(head_sha, {{'t': created_at, 'r': run_id}}) as sha from workflow_runs where head_branch is not null group by 1")
def s17(s, d):
    return v.workflow_runs(s, d).where("head_branch is not null").groupBy(F.col("head_branch").alias("name")).agg(F.max_by("head_sha", F.struct("created_at", "run_id")).alias("sha"))


@query("s4_single_requests", "select event_id, case when event_id % 3 = 0 then 400 else 200 end as status, case when event_id % 2 = 0 then 'a.py' else '<stdin>' end as filename from events")
def s4(s, d):
    n = F.col("event_id")
    body = F.to_json(F.struct(F.when(n % 3 == 0, "  ").otherwise("x = 1").alias("source"), F.when(n % 2 == 0, "a.py").alias("filename")))
    return records.requests(v.table(s, d, "events").select("event_id", body.alias("body")), "body").select("event_id", "status", "filename")


@query("s5_batch_requests", "select user_id, status, count(*) as n from (select user_id, 400 as status, 1 as i from events where event_id % 4 = 0 union all select user_id, 200, unnest(range(event_id % 3 + 1)) from events where event_id % 4 > 0) group by 1, 2")
def s5(s, d):
    n = F.col("event_id")
    items = F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda i: F.struct(F.lit("x = 1").alias("source"), F.concat(F.lit("f"), i.cast("string")).alias("filename")))
    body = F.when(n % 4 == 0, '{"files": []}').otherwise(F.to_json(F.struct(items.alias("files"))))
    got = records.batch_requests(v.table(s, d, "events").select(F.struct("event_id", "user_id").alias("key"), body.alias("body")), "body", "key")
    return got.groupBy(F.col("key.user_id").alias("user_id"), "status").agg(F.count("*").alias("n"))


@query("t4_distinct_edges", "select distinct user_id as unit, event_id % 7 as src, event_id % 5 as dst, nullif(case when event_id % 3 = 0 then 'True' when event_id % 3 = 1 then 'x > 1' end, 'True') as guard from events")
def t4(s, d):
    n = F.col("event_id")
    e = v.table(s, d, "events").select(F.col("user_id").alias("unit"), (n % 7).alias("src"), (n % 5).alias("dst"), F.when(n % 3 == 0, "True").when(n % 3 == 1, "x > 1").alias("guard"))
    return graphs.distinct_edges(e)


@query("t5_listed_blocks", f"{W}, b as (select path, func, count(*) filter (level = 'error' and k % 3 = 0) as n_stmts, min(line) = 1 as is_entry from findings group by 1, 2) select path, func from b where n_stmts > 0 or is_entry")
def t5(s, d):
    """Functions of a file stand for blocks: those with statements, and the entry, are listed."""
    stmts, entry = F.count_if((F.col("level") == "error") & (F.col("k") % 3 == 0)), F.min("line") == 1
    return graphs.listed_blocks(v.findings(s, d).groupBy("path", "func").agg(stmts.alias("n_stmts"), entry.alias("is_entry"))).select("path", "func")


EDGES = "g as (select s_suppkey as unit, cast(range as bigint) as src from supplier, range(7)), edges as (select unit, src, src * 2 + 1 as dst from g where src * 2 + 1 < 12 union all select unit, src, src * 2 + 2 from g where src * 2 + 2 < 12 + unit % 3 union all select unit, 5, 1 from nation_units where unit % 2 = 0)".replace("nation_units", "(select distinct unit from g)")


def edges(s, d):
    g = v.table(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("unit")).crossJoin(s.range(7).withColumnRenamed("id", "src"))
    a = g.select("unit", "src", (F.col("src") * 2 + 1).alias("dst")).where("dst < 12")
    b = g.select("unit", "src", (F.col("src") * 2 + 2).alias("dst")).where("dst < 12 + unit % 3")
    back = g.where("unit % 2 = 0").select("unit").distinct().select("unit", F.lit(5).cast("bigint").alias("src"), F.lit(1).cast("bigint").alias("dst"))
    return a.unionByName(b).unionByName(back)


@query("d1_path_enumeration", f"with recursive {EDGES}, walk(unit, node, path) as (select distinct unit, cast(0 as bigint), [cast(0 as bigint)] from edges union all select e.unit, e.dst, list_append(w.path, e.dst) from walk w join edges e on e.unit = w.unit and e.src = w.node where not list_contains(w.path, e.dst)) select unit, path from walk w where not exists (select 1 from edges e where e.unit = w.unit and e.src = w.node)")
def d1(s, d):
    return graphs.paths(s, edges(s, d))


DIAMONDS = "edges as (select s_suppkey as unit, 3 * i + a as src, 3 * i + b as dst from supplier, range(10) r(i), (values (0, 1), (0, 2), (1, 3), (2, 3)) t(a, b) where i < 4 + s_suppkey % 7)"


def diamonds(s, d):
    """Branches and joins in a row, four to ten of them, so that a unit has 16 to 1,024 paths."""
    links = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))])
    e = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.explode(F.sequence(F.lit(0).cast("bigint"), (3 + F.col("s_suppkey") % 7).cast("bigint"))).alias("i"))
    return e.select("unit", "i", F.explode(links).alias("l")).select("unit", (3 * F.col("i") + F.col("l.a")).alias("src"), (3 * F.col("i") + F.col("l.b")).alias("dst"))


@query("d1_first_paths", f"""with recursive {DIAMONDS},
w as (select distinct unit, 0::bigint as node, [0::bigint] as path from edges union all select e.unit, e.dst, list_append(w.path, e.dst) from w join edges e on e.unit = w.unit and e.src = w.node),
p as (select unit, path, row_number() over (partition by unit order by path) as n, count(*) over (partition by unit) as paths from w where not exists (select 1 from edges e where e.unit = w.unit and e.src = w.node))
select unit, path, paths > 200 as truncated from p where n <= 200""")
def d1_first(s, d):
    return graphs.first_paths(diamonds(s, d))


@query(
    "t19_graph_layers",
    f"with recursive {EDGES}, nodes as (select distinct unit, unnest(range(16)) as node from edges), walk(unit, node, layer) as (select distinct unit, cast(0 as bigint), cast(0 as bigint) from edges union select e.unit, e.dst, layer + 1 from walk w join edges e on e.unit = w.unit and e.src = w.node where layer < 20), near as (select unit, node, min(layer) as layer from walk group by 1, 2), far as (select unit, max(layer) + 1 as last from near group by 1) select n.unit, n.node, coalesce(layer, last) as layer from nodes n left join near using (unit, node) join far on far.unit = n.unit",
)
def t19(s, d):
    e = edges(s, d)
    nodes = e.select("unit").distinct().crossJoin(s.range(16).withColumnRenamed("id", "node"))
    return graphs.layers(s, nodes, e)
