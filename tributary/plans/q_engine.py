"""Queries of the analyzer over source units made from events, and of the incremental store."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from tributary.functions import corpus, specs
from tributary.operators import engine, memo, rollups
from tributary.plans import views as v
from tributary.plans.base import query
from tributary.sources import knowledge

N = len(corpus.TEMPLATES)


def case(pick, quote: bool = True) -> str:
    """A SQL CASE over the template of a unit."""
    text = lambda x: f"'{x}'" if quote else str(x)
    return f"case event_id % {N} " + " ".join(f"when {i} then {text(pick(t))}" for i, t in enumerate(corpus.TEMPLATES)) + " end"


def units(s, d, distinct: bool = False):
    """One source for each event: a template by its id, with names and numbers by its k, or by its id if all are to differ."""
    templates = s.createDataFrame([(i, t[0], t[1], t[4]) for i, t in enumerate(corpus.TEMPLATES)], "template int, name string, expected string, body string")
    e = v.table(s, d, "events").select(F.col("event_id").alias("unit_id"), (F.col("event_id") % N).cast("int").alias("template"), (F.col("event_id") if distinct else F.expr(v.K)).alias("k"))
    text = F.replace(F.replace(F.replace("body", F.lit("{f}"), F.concat(F.lit("fn"), F.col("k").cast("string"))), F.lit("{v}"), F.concat(F.lit("h"), (F.col("k") % 7).cast("string"))), F.lit("{n}"), F.col("k").cast("string"))
    return e.join(F.broadcast(templates), "template").select("unit_id", "template", F.concat(F.lit("src/m"), (F.col("k") % 20).cast("string"), F.lit(".py")).alias("path"), "expected", text.alias("source"))


def plain(s, d):
    return units(s, d).select("unit_id", "path", "source")


@query("s9_labelled_units", f"select expected, count(*) as units from (select {case(lambda t: t[1])} as expected from events) group by 1")
def s9(s, d):
    return units(s, d).groupBy("expected").agg(F.count("*").alias("units"))


@query("t1_parse_status", f"select event_id as unit_id, {case(lambda t: t[2])} = 'error' as failed from events")
def t1(s, d):
    return engine.verdicts(plain(s, d)).select("unit_id", F.col("parse_error").isNotNull().alias("failed"))


@query("a26_unit_verdicts", f"select event_id as unit_id, {case(lambda t: t[2])} as verdict, {case(lambda t: t[3], False)} as n_findings from events")
def a26(s, d):
    return engine.verdicts(plain(s, d)).select("unit_id", "verdict", "n_findings")


@query("a26_distinct_sources", f"select event_id as unit_id, {case(lambda t: t[2])} as verdict, {case(lambda t: t[3], False)} as n_findings from events")
def a26_distinct(s, d):
    """Verdicts where no two sources are equal, so that every unit is analyzed."""
    return engine.verdicts(units(s, d, distinct=True).select("unit_id", "path", "source")).select("unit_id", "verdict", "n_findings")


#: Verdicts as published for the kinds of labelled cases: all right but one leak that is called potential.
BENCH = f"""with u as (select {case(lambda t: t[1])} as expected, {case(lambda t: t[2])} as verdict from events where event_id % {N} < {corpus.LABELLED}),
g as (select count(*) filter (expected = 'leak' and verdict = 'leak') as tp, count(*) filter (expected <> 'leak' and verdict <> 'leak') as tn, count(*) filter (expected <> 'leak' and verdict = 'leak') as fp, count(*) filter (expected = 'leak' and verdict <> 'leak') as fn from u),
m as (select *, tp / (tp + fp)::double as p, tp / (tp + fn)::double as q from g)
select tp, tn, fp, fn, round(p, 3) as precision, round(q, 3) as recall, round(2 * p * q / (p + q), 3) as f1, round((tp + tn) / (tp + tn + fp + fn)::double, 3) as accuracy from m"""


@query("a18_benchmark_metrics", BENCH)
def a18_bench(s, d):
    u = units(s, d).where(f"template < {corpus.LABELLED}").select("unit_id", "expected", "source")
    return rollups.confusion(engine.verdicts(u))


def reason_query(name: str, reason: str, templates: list[str]):
    inside = ", ".join(str(i) for i, t in enumerate(corpus.TEMPLATES) if t[0] in templates)

    @query(name, f"select event_id as unit_id from events where event_id % {N} in ({inside})")
    def run(s, d):
        f = engine.findings(plain(s, d)).where("parse_error is null")
        return f.where(F.array_contains("reasons", reason)).select("unit_id").distinct()


reason_query("d3_overwritten_handles", "reassignment", ["overwritten"])
reason_query("d9_callee_leaks", "callee leak", ["helper_may_close"])
reason_query("d11_loop_bypass", "loop bypass", ["loop_continue", "server_loop"])
reason_query("d12_early_returns", "early return", ["returned_tuple", "match_case", "many_branches", "simple", "early_return", "loop", "handler_returns", "two_handles", "socket", "database", "tangle", "one_line", "in_try"])
reason_query("d18_exception_candidates", "exception", ["keyword_only", "simple", "early_return", "loop", "handler_calls", "two_handles", "overwritten", "helper_may_close", "socket", "database", "tangle", "second_raises", "read_close", "unknown_callee"])


@query("d22_exception_only_findings", f"select event_id as unit_id from events where event_id % {N} in ({', '.join(str(i) for i, t in enumerate(corpus.TEMPLATES) if t[0] in ('handler_calls', 'second_raises', 'read_close'))})")
def d22(s, d):
    return engine.findings(plain(s, d)).where("kind = 'exception'").select("unit_id")


@query("d10_potential_findings", f"select event_id as unit_id, 'warning' as severity, 'unknown' as fixability from events where event_id % {N} in ({', '.join(str(i) for i, t in enumerate(corpus.TEMPLATES) if t[2] == 'potential')})")
def d10(s, d):
    return engine.findings(plain(s, d)).where("confidence = 'potential'").select("unit_id", "severity", "fixability")


CAT = {"socket": "socket", "database": "database"}


@query("d14_resource_types", f"select event_id as unit_id, {case(lambda t: CAT.get(t[0], 'file'))} as resource_type from events where {case(lambda t: t[3], False)} > 0")
def d14(s, d):
    return engine.findings(plain(s, d)).where("parse_error is null").select("unit_id", "resource_type").distinct()


#: (local name, canonical name) of the only import that a template has.
IMPORTED = {"temp_dir": ("tempfile", "tempfile"), "socket": ("socket", "socket"), "database": ("db", "sqlite3"), "process_waits": ("subprocess", "subprocess"), "closing": ("contextlib", "contextlib"), "exit_stack": ("contextlib", "contextlib"), "known_by_rule": ("vault", "vault")}


@query("t6_import_map", f"select event_id as unit_id, {case(lambda t: IMPORTED.get(t[0], ('', ''))[0])} as local, {case(lambda t: IMPORTED.get(t[0], ('', ''))[1])} as canonical from events where {case(lambda t: t[0] in IMPORTED, False)}")
def t6(s, d):
    return engine.imports(plain(s, d)).where("parse_error is null").select("unit_id", "local", "canonical")


ACQUIRED = {"temp_dir": "tempfile.TemporaryDirectory", "socket": "socket.socket", "database": "sqlite3.connect", "process_waits": "subprocess.Popen", "with": "", "nested_with": "", "with_in_loop": "", "exit_stack": "", "known_by_rule": "", "syntax_error": ""}
TWICE = ("two_handles", "overwritten", "second_raises", "one_line")
IN_LOOP = ("loop", "tangle", "loop_continue", "server_loop")


@query("t7_acquires", f"select event_id as unit_id, {case(lambda t: ACQUIRED.get(t[0], 'open'))} as acquire, cast({case(lambda t: 2 if t[0] in TWICE else 1, False)} as bigint) as n, {case(lambda t: t[0] in IN_LOOP, False)} as in_loop from events where {case(lambda t: ACQUIRED.get(t[0], 'open'))} <> ''")
def t7(s, d):
    return engine.acquires(plain(s, d)).where("parse_error is null").groupBy("unit_id", "acquire").agg(F.count("*").alias("n"), F.bool_or("in_loop").alias("in_loop"))


@query("t17_complexity", f"select event_id as unit_id, {case(lambda t: len([x for x in t[4].splitlines() if x.strip()]), False)} as loc, {case(lambda t: t[4].count('def '), False)} as functions, {case(lambda t: t[4].count(' if '), False)} as branches, {case(lambda t: t[4].count('for p in') + t[4].count('while '), False)} as loops from events where {case(lambda t: t[2])} <> 'error'")
def t17(s, d):
    return engine.complexity(plain(s, d)).where("parse_error is null").select("unit_id", "loc", "functions", "branches", "loops")


#: Blocks and edges of the functions of each template, counted by hand from the shapes: an if without else adds two blocks
#: and an edge into each, and one out of a body that falls through; a loop adds its head, body and what follows; a try its
#: body, its handlers (entered from before it) and what follows; a with adds none; nothing follows a return or continue.
#: What is not named is one block without edges. The blocks after finally_closes' and server_loop's ends are never entered.
SHAPES = {
    "early_return": (3, 2), "loop": (6, 6), "handler_returns": (4, 3), "handler_calls": (4, 4), "two_handles": (6, 5), "helper_may_close": (1 + 3, 0 + 2), "socket": (3, 2), "database": (3, 2),
    "finally_closes": (3, 1), "with_in_loop": (4, 4), "tangle": (13, 16), "helper_closes": (1 + 1, 0), "loop_continue": (6, 7), "match_case": (4, 3), "many_branches": (1 + 9 * 2, 9 * 3),
    "helper_picks": (1 + 3, 0 + 2), "helper_names": (1 + 1, 0), "server_loop": (4 + 90 * 2, 3 + 90 * 3), "in_try": (4, 3),
}

#: Blocks of a template on leaking paths, and those on safe paths only, where not (1, 0) for a leak and (0, 0) else. The
#: walk of many_branches and server_loop is cut short, but not before it has entered each block.
TAGS = {
    "early_return": (2, 1), "loop": (4, 0), "handler_returns": (2, 2), "handler_calls": (0, 4), "two_handles": (6, 0), "socket": (2, 1), "database": (2, 1), "second_raises": (0, 1), "read_close": (0, 1),
    "tangle": (11, 0), "module_level": (0, 0), "loop_continue": (4, 0), "match_case": (2, 2), "many_branches": (19, 0), "server_loop": (183, 0), "in_try": (3, 0),
}
HAS_FUNCTION = case(lambda t: "def " in t[4] and t[2] != "error", False)


@query("t2_t3_control_flow", f"select event_id as unit_id, {case(lambda t: t[4].count('def '), False)} as functions, {case(lambda t: SHAPES.get(t[0], (1, 0))[0], False)} as blocks, {case(lambda t: SHAPES.get(t[0], (1, 0))[1], False)} as edges from events where {HAS_FUNCTION}")
def t3(s, d):
    b = engine.blocks(plain(s, d)).where("parse_error is null and func is not null")
    return b.groupBy("unit_id").agg(F.count_if("is_entry").cast("int").alias("functions"), F.count("*").cast("int").alias("blocks"), F.sum(F.size("exits")).cast("int").alias("edges"))


@query("p23_exit_labels", f"select event_id as unit_id, {case(lambda t: t[4].count(' if ') + t[4].count('for p in') + t[4].count('match '), False)} as true_or_false, {case(lambda t: t[4].count('while True'), False)} as endless, {case(lambda t: t[4].count('except '), False)} as handlers from events where {HAS_FUNCTION}")
def p23(s, d):
    """Blocks with a true and a false exit, loops without end, and exits to handlers."""
    b = engine.blocks(plain(s, d)).where("parse_error is null and func is not null")
    labels = F.col("labels")
    both = F.sort_array(labels) == F.array(F.lit("FALSE"), F.lit("TRUE"))
    count = lambda c, n: F.count_if(c).cast("int").alias(n)
    return b.groupBy("unit_id").agg(count(both, "true_or_false"), count(labels == F.array(F.lit("loop")), "endless"), F.sum(F.size(F.filter("labels", lambda x: x == "except"))).cast("int").alias("handlers"))


def preorder(source: str) -> list[tuple[str, int, int]]:
    """(type, depth, parent's place) of all nodes of a source down to depth 10, in preorder."""
    out: list[tuple[str, int, int]] = []
    todo = [(ast.parse(source), 0, -1)]
    while todo:
        n, depth, parent = todo.pop()
        out.append((type(n).__name__, depth, parent))
        if depth < 10:
            todo += [(c, depth + 1, len(out) - 1) for c in reversed(list(ast.iter_child_nodes(n)))]
    return out


def listed(source: str) -> list[tuple[str, int]]:
    """(type, depth) of the nodes that are listed: the first 600, and children of the first 599 beyond them."""
    return [(kind, depth) for i, (kind, depth, parent) in enumerate(preorder(source)) if i < 600 or parent < 599]


PARSED = [(i, listed(corpus.source(i, 0))) for i, t in enumerate(corpus.TEMPLATES) if t[2] != "error"]
NODES = "nodes(template, type, n, depth) as (values " + ", ".join(f"({i}, '{k}', {sum(x == k for x, _ in rows)}, {max(y for x, y in rows if x == k)})" for i, rows in PARSED for k in sorted({x for x, _ in rows})) + ")"


@query("t15_ast_rows", f"with {NODES} select type, cast(sum(n) as bigint) as n, max(depth) as depth from events join nodes on event_id % {N} = template group by type")
def t15(s, d):
    return engine.nodes(plain(s, d)).where("parse_error is null").groupBy("type").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


BIG = [(i, len(rows)) for i, rows in PARSED if len(rows) >= 600]


@query("o7_ast_budget", f"select event_id as unit_id, case event_id % {N} {' '.join(f'when {i} then {n}' for i, n in BIG)} end as nodes from events where event_id % {N} in ({', '.join(str(i) for i, _ in BIG)})")
def o7(s, d):
    """Units whose syntax tree reaches the budget; siblings of the node that reaches it are still listed."""
    return engine.nodes(plain(s, d)).where("parse_error is null").groupBy("unit_id").agg(F.count("*").cast("int").alias("nodes")).where("nodes >= 600")


@query("t16_blocks_in_leaks", f"select event_id as unit_id, {case(lambda t: TAGS.get(t[0], (int(t[3] > 0), 0))[0], False)} as leak, {case(lambda t: TAGS.get(t[0], (int(t[3] > 0), 0))[1], False)} as safe, {case(lambda t: t[4].count('def '), False)} as entries from events where {HAS_FUNCTION}")
def t16(s, d):
    b = engine.tagged_blocks(plain(s, d)).where("parse_error is null and func is not null")
    return b.groupBy("unit_id").agg(F.count_if(F.col("tag") == "leak").cast("int").alias("leak"), F.count_if(F.col("tag") == "safe").cast("int").alias("safe"), F.count_if("is_entry").cast("int").alias("entries"))


EFFECTS = {"helper_may_close": "leaks", "helper_closes": "releases", "helper_picks": "escapes", "helper_names": "escapes"}


@query("d16_parameter_effects", f"select event_id as unit_id, {case(lambda t: EFFECTS.get(t[0], ''))} as effect from events where {case(lambda t: t[0] in EFFECTS, False)}")
def d16(s, d):
    return engine.effects(plain(s, d)).where("param = 'h'").select("unit_id", "effect")


@query("d27_scouted_acquires", f"select event_id as unit_id, cast({case(lambda t: 2 if t[0] in TWICE else 1, False)} as bigint) as n from events where {case(lambda t: '' if t[0] in ('closing', 'with_handle') else ACQUIRED.get(t[0], 'open'))} <> ''")
def d27(s, d):
    return engine.scouted(plain(s, d)).where("parse_error is null").groupBy("unit_id").agg(F.count("*").alias("n"))


#: Acquisitions that a scout reports (all that no with statement is about) and that no finding is at: those of templates
#: without findings, and the second of overwritten (released) and of second_raises (released by what may raise no more).
EXCEPTION_ONLY = ("handler_calls", "second_raises", "read_close")
SCOUTED = [
    (i, ACQUIRED.get(t[0], "open"), verdict, n)
    for i, t in enumerate(corpus.TEMPLATES)
    if ACQUIRED.get(t[0], "open") and t[0] not in ("closing", "with_handle")
    for all_of in [2 if t[0] in TWICE else 1]
    for refuted in [all_of if not t[3] else int(t[0] in ("overwritten", "second_raises"))]
    for verdict, n in [("refuted_safe", refuted), ("confirmed_exception_unsafe" if t[0] in EXCEPTION_ONLY else "confirmed_path_leak", all_of - refuted)]
    if n
]


@query("s21_ensemble_verdicts", f"with scouted(template, rule, verdict, n) as (values {', '.join(map(str, SCOUTED))}) select rule, verdict, cast(sum(n) as bigint) as n from events join scouted on event_id % {N} = template group by rule, verdict")
def s21(s, d):
    return engine.ensemble(plain(s, d)).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


#: Fixes that a template's source gets; each of them ends all its findings.
FIXED = {"simple": 1, "early_return": 1, "handler_calls": 1, "two_handles": 2, "helper_may_close": 1, "socket": 1, "database": 1, "second_raises": 1, "read_close": 1, "module_level": 1, "keyword_only": 1, "returned_tuple": 1, "match_case": 1, "many_branches": 1}
#: Edits that are turned down: statements that share a line cannot be moved apart.
REJECTED = {"one_line": 1}


@query("d30_validated_fixes", f"select event_id as unit_id, {case(lambda t: FIXED.get(t[0], 0), False)} as applied, {case(lambda t: REJECTED.get(t[0], 0), False)} as rejected, {case(lambda t: t[0] in FIXED or t[2] == 'safe', False)} as safe from events where {case(lambda t: t[2] != 'error', False)}")
def d30(s, d):
    """What the fixer does to every unit, and whether the source that comes out is safe."""
    fixed = engine.fixed(plain(s, d)).where("parse_error is null")
    again = fixed.select("unit_id", F.size("applied").alias("applied"), F.size("rejected").alias("rejected"), F.col("fixed_source").alias("source"))
    return engine.verdicts(again).select("unit_id", "applied", "rejected", (F.col("verdict") == "safe").alias("safe"))


#: What the knowledge base changes: a rule makes vault.checkout an acquisition; a contract makes elsewhere() a release.
KNOWN = {"known_by_rule": ("leak", 1), "unknown_callee": ("safe", 0)}


@query("d24_knowledge_base_rules", f"select event_id as unit_id, {case(lambda t: KNOWN.get(t[0], (t[2], t[3]))[0])} as verdict, {case(lambda t: KNOWN.get(t[0], (t[2], t[3]))[1], False)} as n_findings from events")
def d24(s, d):
    config = specs.with_knowledge(specs.Config(), corpus.KNOWLEDGE)
    return engine.verdicts(plain(s, d), config).select("unit_id", "verdict", "n_findings")


KB = """kb as (select p_partkey, case p_partkey % 5 when 0 then 'a: [' when 1 then '- 1' when 2 then '' else
  'resources:' || chr(10) || '- {call: lib' || p_partkey % 50 || '.make, close: [drop' || p_partkey % 3 || ', end]}' || chr(10) || '- not a rule' || chr(10) ||
  'api_contracts:' || chr(10) || '- {library: lib' || p_partkey % 50 || ', function: give, behavior: ' || case p_partkey % 4 when 0 then 'CLOSES_INPUT' else 'RETURNS_RESOURCE' end || '}' || chr(10) || '- {library: none}' end as body from part)"""


def knowledge_bases(s, d):
    """A YAML document for each part; some are no mapping, some do not parse."""
    lib = "concat('lib', p_partkey % 50)"
    rules = f"concat('resources:\\n- {{call: ', {lib}, '.make, close: [drop', p_partkey % 3, ', end]}}\\n- not a rule\\n')"
    contracts = f"concat('api_contracts:\\n- {{library: ', {lib}, ', function: give, behavior: ', if(p_partkey % 4 = 0, 'CLOSES_INPUT', 'RETURNS_RESOURCE'), '}}\\n- {{library: none}}')"
    return v.table(s, d, "part").select("p_partkey", F.expr(f"case p_partkey % 5 when 0 then 'a: [' when 1 then '- 1' when 2 then '' else concat({rules}, {contracts}) end").alias("body"))


@query("s7_knowledge_base", f"""with {KB}, f as (select p_partkey from kb where body like 'resources%')
select p_partkey, 'rule' as kind, 'lib' || p_partkey % 50 || '.make' as name, 'drop' || p_partkey % 3 as release, null as behavior from f
union all select p_partkey, 'contract', 'lib' || p_partkey % 50 || '.give', null, case p_partkey % 4 when 0 then 'CLOSES_INPUT' else 'RETURNS_RESOURCE' end from f""")
def s7(s, d):
    """Rules and contracts of knowledge bases; entries that are no mappings, and texts that do not parse, have none."""
    return knowledge.rules(knowledge_bases(s, d), "p_partkey", "body").select("p_partkey", "kind", "name", "release", "behavior")


@query("d26_first_contract", f"with {KB}, f as (select * from kb where body like 'resources%') select 'lib' || p_partkey % 50 || '.give' as name, min_by(case p_partkey % 4 when 0 then 'CLOSES_INPUT' else 'RETURNS_RESOURCE' end, p_partkey) as behavior from f group by 1")
def d26(s, d):
    """Of the contracts for one function the first counts."""
    return knowledge.first_contracts(knowledge.rules(knowledge_bases(s, d), "p_partkey", "body"), "p_partkey").select("name", "behavior")


DEFAULTS = "defaults(pos, acquire, release, others) as (values " + ", ".join(f"({i}, '{x.acquire}', '{x.release}', '{','.join(x.others)}')" for i, x in enumerate(specs.Config().specs)) + ")"


@query("s8_configured_specs", f"""with {DEFAULTS}
select p_partkey, pos::int as pos, acquire, release, others, p_partkey % 5 <> 1 as exception_safety from part, defaults where p_partkey % 5 < 4
union all select p_partkey, 0, 'lib.f' || p_partkey, 'close', 'end,drop', false from part where p_partkey % 5 = 4
union all select p_partkey, 1, 'lib.g', 'stop', '', false from part where p_partkey % 5 = 4""")
def s8(s, d):
    """Specs of JSON configurations; an empty or absent list, and what is no JSON, stand for the default ones."""
    own = "concat('{\"resources\": [{\"acquire\": \"lib.f', p_partkey, '\", \"alt_releases\": [\"end\", \"drop\"]}, {\"acquire\": \"lib.g\", \"release\": \"stop\"}], \"exception_safety\": false}')"
    text = F.expr(f"case p_partkey % 5 when 0 then '{{}}' when 1 then '{{\"exception_safety\": false, \"resources\": []}}' when 2 then 'no json' when 3 then null else {own} end")
    found = knowledge.configured(v.table(s, d, "part").select("p_partkey", text.alias("body")), "p_partkey", "body")
    return found.select("p_partkey", "pos", "acquire", "release", F.array_join("others", ",").alias("others"), "exception_safety")


@query("k12_fixed_sources")
def k12(s, d):
    return engine.fixed(plain(s, d)).select("unit_id", "path", "parse_error", "fixed_source", "applied", "rejected")


@query("k1_text_report")
def k1(s, d):
    return engine.text_report(engine.findings(plain(s, d)).where("parse_error is null"))


@query("k2_json_documents")
def k2(s, d):
    return engine.json_report(engine.findings(plain(s, d)))


COLUMNS = ["acquire", "acquire_line", "cleanup_line", "col", "confidence", "exception_note", "file", "fixability", "func", "kind", "leak_reasons", "leaking_paths", "line", "message", "release", "resource_type", "rule", "safe_paths", "severity", "var"]
SURE = case(lambda t: sum([t[3] if t[2] == "leak" else 0]), False)


@query("k2_json_records", f"select event_id as unit_id, {case(lambda t: t[3], False)} as records, '{','.join(COLUMNS)}' as fields, {SURE} as errors, 'src/m' || (cast(json_extract_string(props, '$.k') as bigint) % 20) || '.py' as file from events where {case(lambda t: t[3], False)} > 0")
def k2_records(s, d):
    """The JSON reports read back: records, their fields, errors among them, and the file that they name."""
    back = engine.json_report(engine.findings(plain(s, d))).select("unit_id", F.from_json("document", "array<map<string,string>>").alias("r"))
    errors = F.size(F.filter("r", lambda x: x["severity"] == "error"))
    return back.select("unit_id", F.size("r").alias("records"), F.array_join(F.sort_array(F.map_keys(F.get("r", 0))), ",").alias("fields"), errors.alias("errors"), F.get("r", 0)["file"].alias("file"))


@query("r3_analyzed_once", f"select count(distinct (event_id % {N}, case when event_id % {N} = {N - 1} then json_extract_string(props, '$.k') else json_extract_string(props, '$.k') end)) as sources, count(*) as units from events")
def r3(s, d):
    return plain(s, d).agg(F.countDistinct("source").alias("sources"), F.count("*").alias("units"))


#: Capacity of the table of results, as the origin's cache has it.
CAPACITY = 512

MEMO = f"""with {v.FINDINGS}, k as (select event_id % 2 as run, sha256(chr(10) || path || ':' || line || ':' || sha) as key, any_value(length(path || ':' || line || ':' || sha)) as n_chars, count(*) as asked from findings group by 1, 2),
t0 as (select key, n_chars, 0 as epoch from k where run = 0 order by key limit {CAPACITY}),
h1 as (select key, any_value(n_chars) as n_chars, max(epoch) as epoch from (select * from t0 union all select key, n_chars, 1 from k where run = 1) group by 1),
t1 as (select * from h1 order by epoch desc, key limit {CAPACITY})"""


def memo_runs(s, d):
    """Two runs of requests over one table of results."""
    f = v.findings(s, d).select("event_id", F.concat_ws(":", "path", "line", "sha").alias("text"))
    compute = lambda c: c.select("key", F.length("text").alias("n_chars"))
    first = memo.run(None, f.where("event_id % 2 = 0"), 0, compute, CAPACITY)
    return first, memo.run(first.table, f.where("event_id % 2 = 1"), 1, compute, CAPACITY)


@query("r3_memo_counts", f"""{MEMO}
select 0 as epoch, sum(asked)::bigint as requests, (sum(asked) - count(*))::bigint as hits, count(*) as misses, greatest(count(*) - {CAPACITY}, 0) as evicted, (select count(*) from t0) as kept from k where run = 0
union all
select 1, sum(asked)::bigint, (sum(asked) - count(*) filter (key not in (select key from t0)))::bigint, count(*) filter (key not in (select key from t0)), (select count(*) from h1) - (select count(*) from t1), (select count(*) from t1) from k where run = 1""")
def r3_counts(s, d):
    first, second = memo_runs(s, d)
    return first.counts.unionByName(second.counts)


@query("r3_memo_table", f"{MEMO} select key, n_chars, epoch from t1")
def r3_table(s, d):
    return memo_runs(s, d)[1].table.select("key", "n_chars", "epoch")


@query("r3_memo_answers", f"with {v.FINDINGS} select event_id, length(path || ':' || line || ':' || sha) as n_chars from findings where event_id % 2 = 1")
def r3_answers(s, d):
    """Answers of the second run, from the table and from what it computes."""
    return memo_runs(s, d)[1].answers.select("event_id", "n_chars")


def flagship(s, d):
    """Findings of the analyzer by repository file, over the units made from events."""
    f = engine.findings(plain(s, d)).where("parse_error is null")
    return f.groupBy("path").agg(F.count("*").alias("findings"), F.count_if(F.col("confidence") == "definite").alias("definite"), F.count_if(F.col("kind") == "exception").alias("exception_only")).orderBy(F.desc("definite"), "path")
