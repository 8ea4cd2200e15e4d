"""Pinned patterns of the analyzer, the rewriter and the configuration."""

import ast
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.functions import corpus, flow, liveness, rewrite
from tributary.functions.specs import Config, Contract, Spec, from_json, load_contracts


@pytest.mark.parametrize("i", range(len(corpus.TEMPLATES)))
def test_template(i):
    name, _, verdict, n, _ = corpus.TEMPLATES[i]
    if verdict == "error":
        with pytest.raises(SyntaxError):
            liveness.analyze(corpus.source(i, 3))
        return
    found = liveness.analyze(corpus.source(i, 3))
    assert (liveness.verdict(found), len(found)) == (verdict, n)


def test_exception_finding_names_the_call_and_can_be_switched_off():
    src = "def g(p):\n    f = open(p)\n    f.read()\n    f.close()\n"
    (f,) = liveness.analyze(src)
    assert "exception" in f["kind"] and "read" in f["message"]
    assert liveness.analyze(src, config=Config(exception_safety=False)) == []


@pytest.mark.parametrize(("safety", "n"), [("GUARANTEED", 0), ("NOT_GUARANTEED", 1), ("UNKNOWN", 1)])
def test_transfer_contract(safety, n):
    c = Config(contracts={("lib", "take"): Contract("TRANSFERS_OWNERSHIP", "TRANSFER", safety)})
    assert len(liveness.analyze("import lib\ndef g(p):\n    f = open(p)\n    lib.take(f)\n", config=c)) == n


def test_contract_that_returns_a_resource_makes_one():
    c = Config(contracts={("lib", "make"): Contract("RETURNS_RESOURCE", "RETURN")})
    (f,) = liveness.analyze("import lib\ndef g():\n    f = lib.make()\n    return 1\n", config=c)
    assert f["acquire"] == "lib.make"


def test_outer_handle_is_flagged_around_an_inner_with():
    (f,) = liveness.analyze("def g(a, b):\n    f = open(a)\n    with open(b) as w:\n        w.read()\n    return 1\n")
    assert f["var"] == "f" and "path" in f["kind"]


def test_overwrite_and_exception_are_one_finding():
    (f,) = liveness.analyze(corpus.source(6, 1))
    assert f["reasons"] == ["reassignment", "exception"]


def test_loop_bypass():
    found = liveness.analyze("def g(ps):\n    for p in ps:\n        f = open(p)\n        if p:\n            continue\n        f.close()\n")
    assert any("loop bypass" in f["reasons"] for f in found)


def test_return_inside_nested_if_runs_the_finally():
    assert liveness.analyze("def g(p):\n    f = open(p)\n    try:\n        if p:\n            return 1\n        return 2\n    finally:\n        f.close()\n", config=Config()) == []


def test_match_statement_branches():
    (f,) = liveness.analyze("def g(p):\n    f = open(p)\n    match p:\n        case 1:\n            f.close()\n        case _:\n            return 2\n", config=Config(exception_safety=False))
    assert f["reasons"] == ["early return"]


def test_path_cap_is_reported():
    body = "".join(f"    if p > {i}:\n        x = {i}\n" for i in range(10))
    (f,) = liveness.analyze(f"def g(p):\n    f = open(p)\n{body}", config=Config(exception_safety=False))
    assert f["truncated"]


def test_imports_and_alternative_releases():
    tree = ast.parse("import a.b\nimport c as d\nfrom m import n as x\nfrom q import *\n")
    assert flow.import_map(tree) == {"a": "a", "d": "c", "x": "m.n"}
    assert liveness.analyze("from subprocess import Popen as P\ndef g():\n    h = P('x')\n    h.kill()\n") == []


def test_spec_matching_works_both_ways():
    assert Spec("open", "close").matches("PIL.Image.open") and Spec("sqlite3.connect", "close").matches("connect")


def test_config_and_contracts():
    assert from_json('{"resources": []}').specs == Config().specs
    assert from_json('{"resources": [{"acquire": "x.y"}]}').specs == (Spec("x.y", "close"),)
    assert load_contracts("a: [") == {} and load_contracts("- 1") == {}
    got = load_contracts("api_contracts:\n- 5\n- {library: l, function: f, behavior: CLOSES_INPUT}\n")
    assert got[("l", "f")].ends


def test_fix_keeps_comments_and_what_stands_before():
    src = "def g(p):\n    # first\n    q = p\n    f = open(q)\n\n    # reads\n    x = f.read()\n    f.close()\n    return x\n"
    new, applied, rejected = rewrite.fix(src)
    assert "with open(q) as f:" in new and "# reads" in new and "# first" in new and "close" not in new
    assert applied == ["g:f"] and not rejected and liveness.analyze(new) == []


def test_scout_skips_guarded_handles():
    assert rewrite.scout("def g(p):\n    f = open(p)\n    with f:\n        pass\n") == []
    assert rewrite.scout("def g(p):\n    f = open(p)\n") == [(2, "f", "open")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["f = open(a)", "f.close()", "x = 1"]), max_size=8))
def test_straight_line_code_agrees_with_next_event(ops):
    """Without branches an acquisition leaks if the next event of its variable is no release."""
    src = "def g(a):\n" + "".join(f"    {o}\n" for o in ops) + "    return 1\n"
    found = {f["acquire_line"] for f in liveness.analyze(src, config=Config(exception_safety=False))}
    events = [(i + 2, o) for i, o in enumerate(ops) if o != "x = 1"]
    lost = {n for k, (n, o) in enumerate(events) if o.startswith("f =") and (k + 1 == len(events) or not events[k + 1][1].startswith("f.close"))}
    assert found == lost


def test_a_leak_behind_the_cap_of_paths_is_found():
    ifs = "".join(f"        if c[{i}]:\n            x = {i}\n" for i in range(1, 10))
    source = f"def f(c, p):\n    if c[0]:\n{ifs}    else:\n        g = open(p)\n        return 1\n"
    found = liveness.analyze(source)
    assert [(f["acquire_line"], f["reasons"][0], f["truncated"]) for f in found] == [(22, "early return", True)]
    safe = source.replace("        g = open(p)\n", "")
    unit = liveness.Unit(safe, Config())
    walk = next(w for _, _, w in liveness.walks(unit))
    assert walk.truncated and ("truncated", 0, "", "f") in walk.events and not liveness.analyze(safe)


def test_guarded_acquisitions_in_a_loop_are_walked_fast():
    body = "".join(f"        if a({i}):\n            h{i} = open(q)\n" for i in range(40))
    began = time.process_time()
    found = liveness.analyze(f"def f(q):\n    while q():\n{body}")
    assert len(found) == 40 and time.process_time() - began < 0.5


def test_many_paths_look_into_a_statement_once(monkeypatch):
    from tributary.functions import flow, liveness

    looks = []
    monkeypatch.setattr(flow, "own_nodes", lambda root, f=flow.own_nodes: (looks.append(root), f(root))[1])
    n = 7  # 128 paths of 21 blocks
    source = "def f(p, a):\n    h = open(p)\n" + "".join(f"    if a > {i}:\n        note({i})\n" for i in range(n)) + "    return a\n"
    found = liveness.analyze(source)
    assert [len(x["leaking_paths"]) for x in found] == [2**n] and not found[0]["truncated"]
    assert len(looks) < 20 * n
