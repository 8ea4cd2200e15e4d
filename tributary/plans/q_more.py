"""More queries of the analyzer: single rules of the walk, reports, and windows over findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tributary.functions import corpus, specs
from tributary.operators import engine, merge, resolver, rollups, rounds
from tributary.plans import views as v
from tributary.plans.base import query
from tributary.plans.q_engine import ACQUIRED, BENCH, EFFECTS, EXCEPTION_ONLY, FIXED, HAS_FUNCTION, IN_LOOP, PARSED, SHAPES, TWICE, N, case, plain, units
from tributary.sources import records
from tributary.streaming import days, store


def among(*names: str) -> str:
    return f"event_id % {N} in ({', '.join(str(i) for i, t in enumerate(corpus.TEMPLATES) if t[0] in names)})"


#: Methods that release a handle in a template, inside and outside finally bodies.
METHODS = {t: "close" for t in ("early_return", "loop", "handler_returns", "handler_calls", "two_handles", "overwritten", "socket", "database", "finally_closes", "tangle", "alias", "second_raises", "read_close", "loop_continue", "match_case")}
METHODS |= {"process_waits": "wait", "temp_dir": "cleanup"}
MANAGED = {"with": "acquire", "nested_with": "acquire", "with_in_loop": "acquire", "closing": "closing", "with_handle": "handle"}


def event_query(name: str, cond: str, detail: str | None, values: dict[str, str]):
    """Units in whose walks something is met, with their verdicts; all units are walked."""
    seen = f", {case(lambda t: values.get(t[0], ''))} as {detail}" if detail else ""

    @query(name, f"select event_id as unit_id, {case(lambda t: t[2])} as verdict{seen} from events where {among(*values)}")
    def run(s, d):
        met = engine.events(plain(s, d)).where(f"parse_error is null and {cond}")
        return met.select("unit_id", "verdict", *([F.col("detail").alias(detail)] if detail else [])).distinct()


event_query("d5_alias_holds_resource", "kind = 'alias'", None, {"alias": ""})
event_query("d7_release_methods", "kind in ('release', 'finally')", "method", METHODS)
event_query("d8_returned_handle_is_passed_on", "kind = 'return'", None, {"returned": ""})
event_query("t9_managed_contexts", "kind = 'managed' and detail <> 'exit stack'", "how", MANAGED)
event_query("t10_exit_stack", "kind = 'managed' and detail = 'exit stack'", None, {"exit_stack": ""})
event_query("t8_finally_releases", "kind = 'finally'", None, {"finally_closes": ""})


def finding_query(name: str, sql: str, cond: str, cols: list[str]):
    @query(name, sql)
    def run(s, d):
        return engine.findings(plain(s, d)).where(f"parse_error is null and {cond}").select(*cols).distinct()


finding_query("d2_truncated_walks", f"select event_id as unit_id from events where {among('many_branches', 'server_loop')}", "truncated", ["unit_id"])
finding_query("d6_keyword_arguments_do_not_release", f"select event_id as unit_id, 'definite' as confidence from events where {among('keyword_only')}", "confidence = 'definite' and message like '%fall-through exit%' and func <> '<module>' and array_contains(reasons, 'exception') and array_contains(reasons, 'fall-through exit')", ["unit_id", "confidence"])
finding_query("d17_module_level_findings", f"select event_id as unit_id, 1 as line from events where {among('module_level')}", "func = '<module>'", ["unit_id", "line"])
finding_query("d21_annotated_path_findings", f"select event_id as unit_id from events where {among('keyword_only', 'simple', 'early_return', 'loop', 'two_handles', 'overwritten', 'helper_may_close', 'socket', 'database', 'tangle', 'unknown_callee')}", "kind = 'path+exception' and exception_note <> ''", ["unit_id"])
finding_query("d23_one_finding_of_both_kinds", f"select event_id as unit_id, 'path+exception' as kind from events where {among('overwritten')}", "array_contains(reasons, 'reassignment') and array_contains(reasons, 'exception')", ["unit_id", "kind"])
finding_query("p12_fixable_findings", f"select event_id as unit_id from events where {among('simple', 'early_return', 'helper_may_close', 'socket', 'database', 'returned_tuple', 'keyword_only', 'match_case', 'many_branches', 'module_level', 'two_handles', 'one_line')}", "fixability = 'safe'", ["unit_id"])


#: Why the first leaking path of a unit's path findings ends, where not by an early return.
REASONS = {"overwritten": "reassignment", "helper_may_close": "callee leak", "loop_continue": "loop bypass", "server_loop": "loop bypass"} | {t: "fall-through exit" for t in ("keyword_only", "unknown_callee", "module_level")}


@query("p24_exit_reasons", f"select event_id as unit_id, {case(lambda t: REASONS.get(t[0], 'early return'))} as reason from events where {case(lambda t: t[3] > 0 and t[0] not in EXCEPTION_ONLY, False)}")
def p24(s, d):
    f = engine.findings(plain(s, d)).where("parse_error is null and kind <> 'exception'")
    return f.select("unit_id", F.get("reasons", 0).alias("reason")).distinct()


#: Units with a leaking path and one on which everything is released: one of each in all these templates.
BOTH = ("early_return", "handler_returns", "overwritten", "helper_may_close", "socket", "database", "match_case")


@query("d13_safe_path_evidence", f"select event_id as unit_id, 1 as leaking, 1 as safe from events where {among(*BOTH)}")
def d13(s, d):
    """Units whose finding also has a path on which everything is released, with how many such paths."""
    f = engine.findings(plain(s, d)).where("parse_error is null and kind <> 'exception' and size(safe_paths) > 0")
    return f.select("unit_id", F.size("leaking_paths").alias("leaking"), F.size("safe_paths").alias("safe"))


@query("d15_merged_by_acquire_line", f"select event_id as unit_id, cast(2 as bigint) as acquired, cast(1 as bigint) as findings, 2 as paths from events where {among('one_line')}")
def d15(s, d):
    """Lines that acquire more than one resource: their findings are one, with the paths of all."""
    u = plain(s, d)
    lines = engine.acquires(u).where("parse_error is null").groupBy("unit_id", F.col("line").alias("acquire_line")).agg(F.count("*").alias("acquired")).where("acquired > 1")
    f = engine.findings(u).where("parse_error is null").groupBy("unit_id", "acquire_line").agg(F.count("*").alias("findings"), F.sum(F.size("leaking_paths")).cast("int").alias("paths"))
    return f.join(lines, ["unit_id", "acquire_line"]).select("unit_id", "acquired", "findings", "paths")


@query("a25_effect_priority", f"select effect, count(*) as n from (select {case(lambda t: EFFECTS.get(t[0], ''))} as effect from events) where effect <> '' group by effect")
def a25(s, d):
    return engine.effects(plain(s, d)).where("param = 'h'").groupBy("effect").agg(F.count("*").alias("n"))


@query("a28_blocks_and_edges", f"select event_id as unit_id, cast({case(lambda t: SHAPES.get(t[0], (1, 0))[0] - t[4].count('def ') + 1, False)} as bigint) as most_blocks, cast({case(lambda t: SHAPES.get(t[0], (1, 0))[1], False)} as bigint) as most_edges, {case(lambda t: t[4].count('def '), False)} as functions from events where {HAS_FUNCTION}")
def a28(s, d):
    """The largest flow graph of each unit (of two functions of a template one is a single block at most)."""
    b = engine.blocks(plain(s, d)).where("func is not null")
    g = b.groupBy("unit_id", "func").agg(F.count("*").alias("blocks"), F.sum(F.size("exits")).alias("edges"))
    return g.groupBy("unit_id").agg(F.max("blocks").alias("most_blocks"), F.max("edges").alias("most_edges"), F.count("*").cast("int").alias("functions"))


@query("j4_argument_effects", f"select event_id as unit_id, 0 as pos, {case(lambda t: EFFECTS.get(t[0], ''))} as effect from events where {among(*EFFECTS)}")
def j4(s, d):
    return engine.effects(plain(s, d)).where("pos = 0 and param = 'h'").select("unit_id", "pos", "effect")


@query("j19_lexical_flags", f"select event_id as unit_id, true as in_loop from events where {among(*IN_LOOP)}")
def j19(s, d):
    u = plain(s, d)
    a = engine.acquires(u).where("parse_error is null and in_loop").select("unit_id", F.col("line").alias("acquire_line"), "in_loop")
    return engine.findings(u).where("parse_error is null").join(a, ["unit_id", "acquire_line"]).select("unit_id", "in_loop")


@query("w5_earliest_path_finding", f"select event_id as unit_id, {case(lambda t: 4 if t[0] == 'loop' else 3 if t[0] in ('socket', 'database', 'tangle', 'loop_continue', 'server_loop', 'in_try') else 1 if t[0] == 'module_level' else 2, False)} as acquire_line from events where {case(lambda t: t[3] > 0 and t[0] not in ('handler_calls', 'second_raises', 'read_close'), False)}")
def w5(s, d):
    f = engine.findings(plain(s, d)).where("parse_error is null and kind <> 'exception'")
    return merge.first_by(f, ["unit_id"], F.asc("acquire_line"), F.asc("var")).select("unit_id", "acquire_line")


@query("w6_first_safe_fix_per_function", f"select event_id as unit_id from events where {among('simple', 'early_return', 'helper_may_close', 'socket', 'database', 'returned_tuple', 'keyword_only', 'match_case', 'many_branches', 'module_level', 'two_handles', 'one_line')}")
def w6(s, d):
    f = engine.findings(plain(s, d)).where("parse_error is null and fixability = 'safe'")
    return merge.first_by(f, ["unit_id", "func"], F.asc("acquire_line")).select("unit_id")


ACQUIRING = case(lambda t: ACQUIRED.get(t[0], "open"))


@query("t11_lexical_try_flags", f"select acquire, cast(sum(n * in_loop) as bigint) as in_loop, cast(sum(n * in_try) as bigint) as in_try, cast(sum(n) as bigint) as n from (select {ACQUIRING} as acquire, {case(lambda t: 2 if t[0] in TWICE else 1, False)} as n, {case(lambda t: int(t[0] in IN_LOOP), False)} as in_loop, {case(lambda t: int(t[0] == 'in_try'), False)} as in_try from events) where acquire <> '' group by acquire")
def t11(s, d):
    return engine.acquires(plain(s, d)).where("parse_error is null").groupBy("acquire").agg(F.count_if("in_loop").alias("in_loop"), F.count_if("in_try").alias("in_try"), F.count("*").alias("n"))


@query("t14_displayed_acquisitions", f"select event_id as unit_id, cast({case(lambda t: 2 if t[0] in TWICE else 1, False)} as bigint) as shown, {ACQUIRING} as acquire, {case(lambda t: 'wait' if t[0] == 'process_waits' else 'cleanup' if t[0] == 'temp_dir' else 'close')} as release from events where {ACQUIRING} <> ''")
def t14(s, d):
    """Acquisitions as the summary shows them, aliased imports included."""
    return engine.displayed(plain(s, d)).where("parse_error is null").groupBy("unit_id").agg(F.count("*").alias("shown"), F.max("acquire").alias("acquire"), F.max("release").alias("release"))


#: Depth of the 260th node of a template's tree in breadth-first order, and how many of them are shown.
SHOWN = {i: sorted(depth for _, depth in rows)[:260] for i, rows in PARSED}
PLACED = f"shown(template, shown, depth) as (values {', '.join(f'({i}, {len(x)}, {x[-1]})' for i, x in SHOWN.items())})"


@query("t18_first_nodes_breadth_first", f"with {PLACED} select event_id as unit_id, cast(shown as bigint) as shown, depth from events join shown on event_id % {N} = template")
def t18(s, d):
    n = engine.nodes(plain(s, d)).where("parse_error is null")
    few = n.withColumn("o", F.expr("row_number() over (partition by unit_id order by depth, parent, node)")).where("o <= 260")
    return few.groupBy("unit_id").agg(F.count("*").alias("shown"), F.max("depth").alias("depth"))


RULES = {"socket": "socket", "database": "db-connect", "process_waits": "process", "temp_dir": "tempfile"}


@query("u4_rule_patterns", f"select rule, count(*) as n from (select {case(lambda t: RULES.get(t[0], 'open'))} as rule from events where {case(lambda t: ACQUIRED.get(t[0], 'open') != '', False)}) group by rule")
def u4(s, d):
    rule = F.when(F.col("acquire").rlike(r"^(io\.)?open$"), "open").when(F.col("acquire").startswith("tempfile."), "tempfile").when(F.col("acquire").startswith("socket."), "socket")
    rule = rule.when(F.col("acquire").rlike("connect$|MongoClient$"), "db-connect").when(F.col("acquire").rlike("^(requests|httpx)"), "http-client").otherwise("process")
    a = engine.acquires(plain(s, d)).where("parse_error is null").select("unit_id", rule.alias("rule")).distinct()
    return a.groupBy("rule").agg(F.count("*").alias("n"))


@query("k5_full_documents")
def k5(s, d):
    return engine.documents(plain(s, d)).select("unit_id", "path", F.coalesce("document", F.to_json(F.struct(F.lit(False).alias("ok"), F.col("parse_error").alias("error")))).alias("document"))


K5 = "struct<summary:struct<leak_count:int,exception_leaks:int,acquires:int,functions_analyzed:int>,leaks:array<struct<rule:string>>,cfg:struct<functions:array<struct<edges:array<struct<label:string>>>>>,fix:struct<applied:array<string>>,ensemble:array<struct<verdict:string>>,ast:array<struct<node:int>>,trajectory:array<struct<step:int>>>"
ACQUIRES = case(lambda t: 0 if not ACQUIRED.get(t[0], "open") else 2 if t[0] in TWICE else 1, False)
TOP = ("import ", "{v} = open")


@query("k5_document_sections", f"with sized(template, nodes) as (values {', '.join(f'({i}, {len(rows)})' for i, rows in PARSED)}) select event_id as unit_id, {case(lambda t: t[3], False)} as leaks, {ACQUIRES} as acquires, {case(lambda t: t[4].count('def ') + t[4].startswith(TOP), False)} as graphs, {case(lambda t: SHAPES.get(t[0], (1, 0))[1], False)} as edges, {case(lambda t: FIXED.get(t[0], 0), False)} as applied, nodes, 7 as steps from events join sized on event_id % {N} = template")
def k5_sections(s, d):
    """The documents read back: sizes of their sections."""
    x = engine.documents(plain(s, d)).where("parse_error is null").select("unit_id", F.from_json("document", K5).alias("x"))
    edges = F.aggregate("x.cfg.functions", F.lit(0), lambda a, f: a + F.size(f["edges"]))
    return x.select("unit_id", F.col("x.summary.leak_count").alias("leaks"), F.col("x.summary.acquires").alias("acquires"), F.col("x.summary.functions_analyzed").alias("graphs"), edges.alias("edges"), F.size("x.fix.applied").alias("applied"), F.size("x.ast").alias("nodes"), F.size("x.trajectory").alias("steps"))


def contracted(function: str, behavior: str, safety: str = "UNKNOWN") -> specs.Config:
    library, _, name = function.rpartition(".")
    return specs.Config(contracts={(library or "builtins", name): specs.Contract(behavior, "UNKNOWN", safety)})


@query("d4_contract_makes_a_resource", f"select event_id as unit_id, 'vault.checkout' as acquire, 'close' as release from events where {among('known_by_rule')}")
def d4(s, d):
    """A call whose contract returns a resource acquires one, which close releases."""
    f = engine.findings(plain(s, d), contracted("vault.checkout", "RETURNS_RESOURCE")).where("parse_error is null")
    return f.where("acquire not in ('open') and resource_type = 'file'").select("unit_id", "acquire", "release")


@query("d19_d20_transfers", f"select event_id as unit_id, 'safe' as guaranteed, 'exception' as unsure from events where {among('unknown_callee')}")
def d19(s, d):
    """Handing a handle over ends its life; where that is not guaranteed, the call itself may raise with the handle open."""
    u = plain(s, d)
    sure = engine.verdicts(u, contracted("elsewhere", "TRANSFERS_OWNERSHIP", "GUARANTEED")).where("verdict = 'safe'").select("unit_id", F.col("verdict").alias("guaranteed"))
    unsure = engine.findings(u, contracted("elsewhere", "TRANSFERS_OWNERSHIP", "NOT_GUARANTEED")).where("parse_error is null").select("unit_id", F.col("kind").alias("unsure"))
    return sure.join(unsure, "unit_id")


@query("d29_with_rewrites", f"select event_id as unit_id, {case(lambda t: FIXED.get(t[0], 0) + t[4].count('with '), False)} as managed, {case(lambda t: t[4].count('def '), False)} as functions from events where {case(lambda t: t[2] != 'error', False)}")
def d29(s, d):
    """With statements of the sources that the fixer gives back, which keep all their functions."""
    count = lambda pattern, name: F.regexp_count("fixed_source", F.lit(pattern)).alias(name)
    return engine.fixed(plain(s, d)).where("parse_error is null").select("unit_id", count(r"(?m)^ *with ", "managed"), count(r"(?m)^def ", "functions"))


PATTERN_PRIORITY = ["open-leak", "socket-leak", "any-leak"]
OUTPUT = "case when event_id % 11 = 0 then '{' else '{\"results\":[{\"check_id\":\"rules.any-leak\",\"start\":{\"line\":' || (event_id % 5 + 1) || '}},{\"check_id\":\"rules.' || case event_id % 3 when 0 then 'open-leak' when 1 then 'socket-leak' else 'other' end || '\",\"start\":{\"line\":' || (event_id % 2 + 1) || '}},{\"check_id\":\"rules.open-leak\",\"start\":{}}]}' end"


@query("s21_pattern_tool_output", f"""with r as (select event_id, event_id % 5 + 1 as line, 'any-leak' as rule, 2 as rank, 0 as place from events union all select event_id, event_id % 2 + 1, case event_id % 3 when 0 then 'open-leak' when 1 then 'socket-leak' else 'other' end, case event_id % 3 when 0 then 0 when 1 then 1 else 3 end, 1 from events)
select event_id as unit_id, cast(line as integer) as line, rule from (select *, row_number() over (partition by event_id, line order by rank, place) as o from r where event_id % 11 <> 0) where o = 1""")
def s21_output(s, d):
    """Findings of a pattern tool's JSON output, the best rule of each line; what does not parse has none."""
    e = v.table(s, d, "events").select(F.col("event_id").alias("unit_id"), F.expr(OUTPUT).alias("body"))
    return records.pattern_findings(e, "body", ["unit_id"], PATTERN_PRIORITY).select("unit_id", "line", "rule")


LINTED = "case when event_id % 11 = 0 then 'no json' else '[{\"code\":\"SIM115\",\"location\":{\"row\":' || (event_id % 7) || ',\"column\":1},\"message\":\"m' || event_id || '\"},null]' end"


@query("s22_linter_output", "select event_id as unit_id, cast(event_id % 7 as integer) as line, 'SIM115' as rule, 'm' || event_id as message from events where event_id % 11 <> 0")
def s22(s, d):
    """Findings of a linter's JSON output."""
    e = v.table(s, d, "events").select(F.col("event_id").alias("unit_id"), F.expr(LINTED).alias("body"))
    return records.linter_findings(e, "body", ["unit_id"]).select("unit_id", "line", "rule", "message")


@query("k11_benchmark_report", f"with m as ({BENCH}) select format('precision {{:.3f}}, recall {{:.3f}}, F1 {{:.3f}}, accuracy {{:.3f}} (TP {{}}, TN {{}}, FP {{}}, FN {{}})', precision, recall, f1, accuracy, tp, tn, fp, fn) as markdown, to_json({{tp: tp, tn: tn, fp: fp, fn: fn, precision: precision, recall: recall, f1: f1, accuracy: accuracy}}) as json from m")
def k11(s, d):
    u = units(s, d).where(f"template < {corpus.LABELLED}").select("unit_id", "expected", "source")
    m = rollups.confusion(engine.verdicts(u))
    line = F.format_string("precision %.3f, recall %.3f, F1 %.3f, accuracy %.3f (TP %d, TN %d, FP %d, FN %d)", "precision", "recall", "f1", "accuracy", "tp", "tn", "fp", "fn")
    return m.select(line.alias("markdown"), F.to_json(F.struct("*")).alias("json"))


@query("k1_report_lines", f"select event_id as unit_id, case when {case(lambda t: t[2])} = 'leak' then 'LEAK' else 'POSSIBLE LEAK' end as title, 'src/m' || (cast(json_extract_string(props, '$.k') as bigint) % 20) || '.py' as path, {case(lambda t: t[3], False)} as lines from events where {case(lambda t: t[3], False)} > 0")
def k1_lines(s, d):
    """The text report read back: what its lines begin with, and the file that they name."""
    parts = F.regexp_extract("report", r"^(POSSIBLE LEAK|LEAK) ([^:]+):(\d+) .* \[[B0-9 >-]*\]$", 1), F.regexp_extract("report", r"^(?:POSSIBLE LEAK|LEAK) ([^:]+):", 1)
    lines = engine.text_report(engine.findings(plain(s, d)).where("parse_error is null")).select("unit_id", parts[0].alias("title"), parts[1].alias("path"))
    return lines.groupBy("unit_id", "title", "path").agg(F.count("*").cast("int").alias("lines"))


W = "with " + v.FINDINGS


@query("o2_ordered_groups", f"{W} select path, count(*) filter (level = 'error') as error, count(*) as total, row_number() over (order by count(*) filter (level = 'error') desc, count(*) desc, path) as place from findings group by path")
def o2(s, d):
    g = v.findings(s, d).groupBy("path").agg(F.count_if(F.col("level") == "error").alias("error"), F.count("*").alias("total"))
    return rollups.numbered(g, "place", F.desc("error"), F.desc("total"), F.asc("path"))


@query("o3_top_repositories", f"{W} select repo, count(*) filter (level = 'error') as errors from findings group by repo order by errors desc, repo limit 50")
def o3(s, d):
    g = v.findings(s, d).groupBy("repo").agg(F.count_if(F.col("level") == "error").alias("errors"))
    return rollups.top(g, 50, F.desc("errors"), F.asc("repo"))


@query("o6_sorted_names", f"with {v.FILES} select path from repo_files order by path")
def o6(s, d):
    return v.repo_files(s, d).select("path").orderBy("path")


@query("s12_repositories", f"{W} select repo, string_split(repo, '/')[1] as owner, count(distinct branch) as branches, max(found_at) as pushed_at from findings group by repo")
def s12(s, d):
    return v.findings(s, d).groupBy("repo").agg(F.countDistinct("branch").alias("branches"), F.max("found_at").alias("pushed_at")).select("repo", F.get(F.split("repo", "/"), 0).alias("owner"), "branches", "pushed_at")


@query("s24_watch_list", "select distinct lower(c_name) as login from customer where c_custkey % 9 = 0 and trim(c_name) <> ''")
def s24(s, d):
    return v.table(s, d, "customer").where("c_custkey % 9 = 0").select(F.lower(F.trim("c_name")).alias("login")).where("login <> ''").distinct()


@query("r6_daily_counts", f"{W} select cast(date_trunc('day', found_at) as date) as day, count(*) filter (level = 'error') as error, count(*) as total from findings group by 1")
def r6(s, d):
    return v.findings(s, d).groupBy(F.to_date("found_at").alias("day")).agg(F.count_if(F.col("level") == "error").alias("error"), F.count("*").alias("total"))


def seen(rows: str) -> str:
    """The findings of a batch by identity, with the latest level and the times that they span."""
    return f"(select {v.FINGERPRINT} as _id, any_value(login) as login, any_value(branch) as branch, any_value(repo) as repo, any_value(source) as source, max_by(level, cast(found_at as varchar) || lpad(cast(event_id as varchar), 12, '0')) as level, min(found_at) as first_seen, max(found_at) as last_seen from findings where {rows} group by 1)"


#: Five batches; all but the first touch some scopes only, and expire what they lack there.
BATCHES = ("event_id % 2 = 0", "event_id % 2 = 1 and login <> 'org3'", "event_id % 5 = 0 and login in ('org1', 'org2')", "event_id % 3 = 0 and login = 'org1'", "event_id % 7 < 3 and login in ('org3', 'org4')")


def after_batches(batches) -> str:
    """CTEs b0, b1, ... of batches and s0, s1, ... of the store after each."""
    out = [f"b{i} as {seen(x)}" for i, x in enumerate(batches)] + ["s0 as (select * from b0)"]
    for i in range(1, len(batches)):
        kept = f"select * from s{i - 1} a where not exists (select 1 from b{i} b where b.login = a.login and b.repo = a.repo and b.source = a.source) or _id in (select _id from b{i})"
        both = ", ".join(f"coalesce(b.{c}, k.{c}) as {c}" for c in ("login", "branch", "repo", "source", "level"))
        out.append(f"s{i} as (select _id, {both}, least(k.first_seen, b.first_seen) as first_seen, greatest(k.last_seen, b.last_seen) as last_seen from ({kept}) k full join b{i} b using (_id))")
    return ", ".join(out)


#: Stores that queries of this session have streamed, by application and tables.
STREAMED: dict[tuple, str] = {}


def streamed(s, d):
    """The place of a store fed by a stream of five batches; the counts after each and their changes are kept beside it."""
    known = (s.sparkContext.applicationId, d)
    if known not in STREAMED:
        place, f = f"{rounds.folder(s)}/stream-{uuid.uuid4().hex}", v.findings(s, d)
        for i, part in enumerate(BATCHES):
            f.where(part).write.parquet(f"{place}/in/{i}")
            stream = s.readStream.schema(f.schema).option("recursiveFileLookup", True).parquet(f"{place}/in")
            store.start(stream, f"{place}/out", f"{place}/at").awaitTermination()
            now = store.counts(s, f"{place}/out", i).withColumn("batch", F.lit(i))
            now.write.mode("append").parquet(f"{place}/counts")
            before = s.read.parquet(f"{place}/counts").where(F.col("batch").isin(i, i - 1))
            sign = F.when(F.col("batch") == i, F.col("n")).otherwise(-F.col("n"))
            before.groupBy("repo", "level", "day").agg(F.sum(sign).alias("n")).where("n <> 0").write.parquet(f"{place}/changes/{i}")
        STREAMED[known] = place
    return STREAMED[known]


@query("r1_streamed_store", f"{W}, {after_batches(BATCHES)} select _id, level, first_seen, last_seen from s4")
def r1(s, d):
    """The store after a stream of five batches, merged on read from a compacted base and the log of later batches."""
    return store.current(s, f"{streamed(s, d)}/out", len(BATCHES) - 1).select("_id", "level", "first_seen", "last_seen")


AFTER = f"{W}, {after_batches(BATCHES)}"
EACH = " union all ".join(f"select {i} as batch, level, count(*) as n from s{i} group by level" for i in range(len(BATCHES)))


@query("a3_maintained_levels", f"{AFTER} {EACH}")
def a3_maintained(s, d):
    """Findings of each level after each of the five batches, from counts that the batches keep up."""
    return s.read.parquet(f"{streamed(s, d)}/counts").groupBy("batch", "level").agg(F.sum("n").alias("n"))


def kept_counts(s, d):
    return store.counts(s, f"{streamed(s, d)}/out", len(BATCHES) - 1)


TOTALS = "count(*) as total, count(*) filter (level = 'error') as errors"


def totals():
    return [F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("level") == "error", F.col("n"))), F.lit(0)).alias("errors")]


@query("a4_maintained_repos", f"{AFTER} select repo, {TOTALS} from s4 group by repo order by errors desc, total desc, repo limit 50")
def a4_maintained(s, d):
    return rollups.top(kept_counts(s, d).groupBy("repo").agg(*totals()), 50, F.desc("errors"), F.desc("total"), F.asc("repo"))


@query("a5_maintained_branches", f"{AFTER} select repo, branch, {TOTALS} from s4 group by repo, branch order by errors desc, total desc, repo, branch limit 100")
def a5_maintained(s, d):
    return rollups.top(kept_counts(s, d).groupBy("repo", "branch").agg(*totals()), 100, F.desc("errors"), F.desc("total"), F.asc("repo"), F.asc("branch"))


DAYS = f"select unnest(generate_series(date '{v.AS_OF[:10]}' - interval 13 days, date '{v.AS_OF[:10]}', interval 1 day))::date as day"


@query("r6_stateful_days", f"{AFTER}, d as ({DAYS}) select day, count(level) filter (level = 'error') as error, count(level) filter (level = 'warning') as warning, count(level) filter (level = 'notice') as notice, count(level) as total from d left join s4 on day = last_seen::date group by day")
def r6_stateful(s, d):
    """The same days from a stateful stream over the changes of the five batches, one batch each."""
    place = streamed(s, d)
    out, own = f"{place}/days-{uuid.uuid4().hex}", days.session(s)
    for i in range(len(BATCHES)):
        changes = own.readStream.schema(store.COUNTS).option("recursiveFileLookup", True).parquet(f"{place}/changes/{{{','.join(map(str, range(i + 1)))}}}")
        days.start(changes, f"{out}/counts", f"{out}/at").awaitTermination()
    return days.buckets(days.current(s, f"{out}/counts"), v.AS_OF, 14)


@query("a8_maintained_days", f"{AFTER}, d as ({DAYS}) select day, count(level) filter (level = 'error') as error, count(level) as total from d left join s4 on day = last_seen::date group by day")
def a8_maintained(s, d):
    """The last 14 days with their live findings, days without findings included; expired findings are taken back."""
    per = kept_counts(s, d).groupBy("day").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("level") == "error", F.col("n"))).alias("error"))
    today = F.to_date(F.lit(v.AS_OF))
    spine = s.range(1).select(F.explode(F.sequence(F.date_sub(today, 13), today)).alias("day"))
    return spine.join(per, "day", "left").select("day", F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("total", F.lit(0)).alias("total"))


def numbered_provider(keys):
    """Answers from a table: sure ones for a third of the functions, doubtful ones for another."""
    n = F.regexp_extract("function", r"(\d+)$", 1).cast("int")
    said = keys.withColumn("n", n).where("n % 3 < 2").select("library", "function", F.lit("closes_input").alias("behavior"), F.lit("CONSUME").alias("ownership"), F.lit("GUARANTEED").alias("exception_safety"), F.when(F.col("n") % 3 == 0, "0.9").otherwise("0.5").alias("confidence"))
    return said


def spoken_provider(library, function):
    """An answer for every second function, one function at a time."""
    return {"behavior": "RETURNS_RESOURCE", "ownership": "RETURN", "confidence": 0.95} if int(function[1:]) % 2 == 0 else None


@query("s23_provider_order", """with c as (select distinct 'lib' || p_partkey % 20 as library, p_partkey % 300 as n from part), u as (select * from c where n % 7 <> 0)
select library, 'f' || n as function, case when n % 7 = 0 then 'known' when n % 3 = 0 then 'table' when n % 2 = 0 then 'spoken' end as provider,
  case when n % 7 = 0 then 'UNKNOWN' when n % 3 = 0 then 'CLOSES_INPUT' else 'RETURNS_RESOURCE' end as behavior from c where n % 7 = 0 or n % 3 = 0 or n % 2 = 0""")
def s23(s, d):
    """Contracts after two providers were asked, in order, for the functions of all calls that had none."""
    part = v.table(s, d, "part").select((F.col("p_partkey") % 20).alias("l"), (F.col("p_partkey") % 300).alias("n"))
    calls = part.select(F.concat(F.lit("lib"), "l", F.lit(".f"), "n").alias("call_name"))
    known = part.where("n % 7 = 0").distinct().select(F.concat(F.lit("lib"), "l").alias("library"), F.concat(F.lit("f"), "n").alias("function"), F.lit("known").alias("provider"), F.lit("UNKNOWN").alias("behavior"))
    found, _ = resolver.answered(resolver.unknown(calls, known), {"table": numbered_provider, "spoken": resolver.by_call(spoken_provider)})
    return resolver.kept(known, found.select("library", "function", "provider", "behavior"))
