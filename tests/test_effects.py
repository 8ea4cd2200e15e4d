"""Effects of functions with many paths on their parameters."""

import ast
import time

from tributary.functions import flow, liveness, rewrite
from tributary.functions.specs import Config, Spec, with_knowledge
from tributary.operators import resolver
from tributary.sources import files


def test_a_late_leaking_path_of_a_helper_is_found():
    ifs = "".join(f"        if a > {i}:\n            x = {i}\n" for i in range(8))
    source = f"def f(path, a):\n    h = open(path)\n    use(h, a)\n    return 1\n\ndef use(h, a):\n    if a:\n{ifs}        h.close()\n    else:\n        return 1\n"
    found = liveness.analyze(source)
    assert [f["confidence"] for f in found] == ["definite"] and "callee leak" in found[0]["reasons"]
    assert liveness.analyze(source.replace("return 1\n", "h.close()\n").replace("use(h, a)\n    h.close()", "use(h, a)\n    return 1")) == []


def test_an_escape_wins_over_a_leak_and_any_mention_escapes():
    source = "def g(a, c):\n    f = open(a)\n    return pick(f, c)\n\ndef pick(h, c):\n    if c:\n        return {0}\n    return None\n"
    for given in ("h", "h.name", "[h]", "wrap(h.raw)"):
        unit = liveness.Unit(source.format(given), Config())
        assert unit.effect("pick", 0) == "escapes" and liveness.analyze(source.format(given)) == []
    assert liveness.Unit(source.format("c"), Config()).effect("pick", 0) == "leaks"
    assert liveness.Unit(source.format("(lambda h: h)(c)"), Config()).effect("pick", 0) == "leaks"


def test_a_loop_of_many_branches_is_walked_in_bounded_time():
    body = "".join(f"        if q > {i}:\n            x = {i}\n" for i in range(40))
    began = time.perf_counter()
    (f,) = liveness.analyze(f"def g(q):\n    while True:\n        h = open(q)\n{body}")
    assert f["truncated"] and f["reasons"] == ["loop bypass"]
    # the leak is behind all branches, and the walk finds it although it cannot walk all paths
    late = f"def g(q):\n    while True:\n        h = open(q)\n{body}        if q == 1:\n            return 1\n        h.close()\n"
    found = liveness.analyze(late)
    assert time.perf_counter() - began < 1.0
    assert [f["reasons"][0] for f in found] == ["early return"] and found[0]["truncated"]
    assert liveness.analyze(late.replace("return 1", "break")) and not liveness.analyze(late.replace("return 1", "x = 1"))


def test_walks_record_what_they_meet():
    source = "import contextlib\ndef g(a, s):\n    f = open(a)\n    w = f\n    try:\n        w.read()\n    finally:\n        w.close()\n    with open(a) as x:\n        y = s.enter_context(open(a))\n    z = open(a)\n    return z\n"
    (walk,) = [w for _, _, w in liveness.walks(liveness.Unit(source, Config()))]
    assert {(k, d) for k, _, _, d in walk.events} == {("alias", "f"), ("finally", "close"), ("managed", "acquire"), ("managed", "exit stack"), ("return", "")}


def test_exits_are_labelled():
    assert flow.exit_labels(["x > 1", "not (x > 1)"]) == ["TRUE", "FALSE"] and flow.exit_labels(["not x", "x"]) == ["FALSE", "TRUE"]
    assert flow.exit_labels([None]) == [None] and flow.exit_labels(["1"]) == ["TRUE"] and flow.exit_labels(["0", "x", "except"]) == ["FALSE", "if x", "except"]
    source = "match x.y:\n    case 1 | 2 if z:\n        a = 1\n    case None:\n        a = 2\n    case [p, q]:\n        a = 3\n    case _:\n        a = 4\n"
    exits = [g for _, g in flow.Flow(ast.parse(source).body).blocks[0].exits]
    assert exits == ["(x.y == 1 or x.y == 2) and (z)", "x.y is None", "x.y matches [p, q]", "no case"]
    two = "match x:\n    case 3:\n        a = 1\n"
    assert flow.exit_labels([g for _, g in flow.Flow(ast.parse(two).body).blocks[0].exits]) == ["TRUE", "FALSE"]


def test_knowledge_bases():
    text = "resources:\n- {call: a.b, close: end}\n- {call: c, alt_releases: [x]}\n- {close: [y]}\n- 7\napi_contracts:\n- {library: l, function: async_make, ownership: RETURN}\n- {library: l, function: make, behavior: CREATES_RESOURCE}\n"
    config = Config()
    more = with_knowledge(config, text)
    assert config == Config() and more.specs[len(config.specs) :] == (Spec("a.b", "end"), Spec("c", "close", ("x",)), Spec("l.async_make", "aclose"), Spec("l.make", "close"))
    assert with_knowledge(config, "- 1") == with_knowledge(config, "a: [") == config
    found = liveness.analyze("import a\ndef g():\n    h = a.b()\n    return 1\n", config=more)
    assert found[0]["acquire"] == "a.b" and not liveness.analyze("import a\ndef g():\n    h = a.b()\n    h.end()\n", config=more)


def test_statements_that_share_a_line_are_not_moved_apart():
    source = "def g(a, b):\n    f = open(a); w = open(b)\n    return 1\n"
    assert rewrite.fix(source) == (source, [], ["g:f: acquisition not found"])


def test_facade_and_table_function(spark, tmp_path):
    import tributary

    leaky = "def g(p):\n    h = open(p)\n    return 1\n"
    (tmp_path / "a.py").write_text(leaky)
    assert tributary.analyze_file(str(tmp_path / "a.py"))[0]["file"] == str(tmp_path / "a.py")
    assert tributary.ResourceSpec("open", "close") in tributary.DEFAULT_RESOURCES and len(tributary.analyze_source(leaky)) == 1
    tributary.register(spark)
    spark.createDataFrame([(1, leaky), (2, "def"), (3, "x = 1")], "id int, source string").createOrReplaceTempView("some_units")
    got = spark.sql("select id, var, parse_error from some_units, lateral leak_findings(source)").collect()
    assert sorted((r["id"], r["var"], (r["parse_error"] or "")[:11]) for r in got) == [(1, "h", ""), (2, None, "SyntaxError")]


def test_files_by_targets_in_order(spark, tmp_path, monkeypatch):
    for name in ("b/x.py", "b/deep/y.py", "a.py", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    monkeypatch.chdir(tmp_path)
    got = files.collect(spark, ["b", "*.py", "none/*.py", str(tmp_path / "b/x.py"), "note.txt"]).orderBy("place", "path").collect()
    assert [(r["source"], r["place"]) for r in got] == [("b/deep/y.py", 0), ("b/x.py", 0), ("a.py", 1)]


def test_command_line(spark, tmp_path, capsys):
    from tributary.__main__ import main

    (tmp_path / "a.py").write_text("def g(p):\n    h = open(p)\n    return 1\n")
    (tmp_path / "b.py").write_text("def (")
    (tmp_path / "c.py").write_text("import a\ndef g():\n    h = a.get()\n    return 1\n")
    (tmp_path / "kb.yaml").write_text("resources:\n- {call: a.get, close: [put]}\n")
    assert main(["scan", str(tmp_path)]) == 1
    out = capsys.readouterr()
    assert out.out.count("LEAK") == 1 and "a.py" in out.out and "b.py: SyntaxError" in out.err
    assert main(["scan", str(tmp_path / "c.py"), "--knowledge", str(tmp_path / "kb.yaml"), "--json"]) == 1
    assert '"acquire":"a.get"' in capsys.readouterr().out
    assert main(["scan", str(tmp_path / "c.py")]) == 0 and main(["fix", str(tmp_path)]) == 0
    assert "with open(p) as h:" in capsys.readouterr().out
    assert main(["benchmark"]) == 0 and "accuracy" in capsys.readouterr().out


def test_providers_are_asked_in_order_and_once_for_each_function(spark):
    asked = {n: spark.sparkContext.accumulator(0) for n in ("first", "second")}

    def provider(name, answers):
        def ask(library, function):
            asked[name].add(1)
            if function == "fails":
                raise OSError("no answer")
            return answers.get(function)

        return resolver.by_call(ask)

    good = {"behavior": "CLOSES_INPUT", "ownership": "CONSUME", "confidence": 0.9}
    first = provider("first", {"a": good, "b": good | {"confidence": 0.5}, "c": good | {"behavior": "odd"}})
    second = provider("second", {"a": good | {"behavior": "UNKNOWN"}, "b": good | {"behavior": "RETURNS_RESOURCE"}, "fails": good})
    calls = spark.createDataFrame([(f"lib.{f}",) for f in ("a", "a", "b", "c", "d", "fails", "known")] + [(None,), ("a",)], "call_name string")
    known = spark.createDataFrame([("lib", "known", "old")], "library string, function string, provider string")
    keys = resolver.unknown(calls, known)
    found, rejected = resolver.answered(keys, {"first": first, "second": second})
    got = {(r["library"], r["function"]): (r["provider"], r["behavior"]) for r in found.collect()}
    assert got == {("lib", "a"): ("first", "CLOSES_INPUT"), ("builtins", "a"): ("first", "CLOSES_INPUT"), ("lib", "b"): ("second", "RETURNS_RESOURCE")}
    assert sorted((r["function"], r["provider"], r["reason"]) for r in rejected.collect()) == [("b", "first", "low confidence"), ("c", "first", "bad behavior")]
    assert (asked["first"].value, asked["second"].value) == (6, 4)
    table = resolver.kept(known, found.select("library", "function", "provider"))
    assert table.count() == 4 and resolver.unknown(calls, table).count() == 3
