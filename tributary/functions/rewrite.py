"""Rewriting a source so that a resource is held by a with statement, keeping comments and layout."""

from __future__ import annotations

import ast

from tributary.functions import flow as cf
from tributary.functions.liveness import analyze, frees, target_of
from tributary.functions.specs import Config


def identity(f: dict) -> tuple:
    """What a finding is about, whatever its line."""
    return f["func"], f["var"], f["acquire"], f["kind"].split("+")[0] if f["kind"] == "exception" else "path"


def with_statement(source: str, finding: dict, releases: tuple[str, ...]) -> str | None:
    """The source with the acquisition turned into a with statement over what follows it in its block, up to the last
    release, which goes; null if there is no such acquisition. What stands before the acquisition stays."""
    tree = ast.parse(source)
    lines = source.splitlines(keepends=True)
    for node in ast.walk(tree):
        for body in (getattr(node, n, None) for n in ("body", "orelse", "finalbody")):
            if not isinstance(body, list):
                continue
            for i, s in enumerate(body):
                var, value = target_of(s) if isinstance(s, ast.stmt) else (None, None)
                if var != finding["var"] or s.lineno != finding["acquire_line"] or not isinstance(value, ast.Call):
                    continue
                own_lines = [{*range(x.lineno, x.end_lineno + 1)} for x in body]
                if any(own_lines[k] & own_lines[k + 1] for k in range(len(body) - 1)):
                    return None  # statements share a line, and lines are what is moved
                frees_at = [k for k in range(i + 1, len(body)) if isinstance(body[k], ast.Expr) and frees(body[k].value, {var}, releases)]
                last = frees_at[-1] if frees_at else len(body)
                used = [k for k in range(i + 1, len(body)) if k not in frees_at and any(isinstance(x, ast.Name) and x.id == var for x in ast.walk(body[k]))]
                end = max([last - 1, *used])
                inner = [k for k in range(i + 1, end + 1)]
                indent = " " * s.col_offset
                head = f"{indent}with {ast.get_source_segment(source, value)} as {var}:\n"
                gone = {x for k in range(i + 1, len(body)) if k in frees_at for x in range(body[k].lineno, body[k].end_lineno + 1)}
                # text between the acquisition and the last inner statement moves in, comments and blank lines too
                top = body[inner[-1]].end_lineno if inner else s.end_lineno
                moved = [x if not x.strip() else "    " + x for n, x in enumerate(lines[s.end_lineno : top], s.end_lineno + 1) if n not in gone]
                if not any(x.strip() and not x.strip().startswith("#") for x in moved):
                    moved.append(f"{indent}    pass\n")
                rest = [x for n, x in enumerate(lines[top:], top + 1) if n not in gone]
                return "".join([*lines[: s.lineno - 1], head, *moved, *rest])
    return None


def fix(source: str, config: Config | None = None) -> tuple[str, list[str], list[str]]:
    """(new source, findings fixed, findings rejected with reasons); an edit must parse, end its finding and make no new one."""
    config = config or Config()
    applied: list[str] = []
    rejected: list[str] = []
    done: set[tuple] = set()
    while True:
        findings = analyze(source, config=config)
        todo = [f for f in findings if (f["fixability"] == "safe" or f["kind"] == "exception") and identity(f) not in done]
        if not todo:
            return source, applied, rejected
        f = todo[0]
        done.add(identity(f))
        spec = next((s for s in config.specs if s.acquire == f["acquire"]), None)
        new = with_statement(source, f, spec.releases if spec else (f["release"],))
        name = f"{f['func']}:{f['var']}"
        if new is None:
            rejected.append(f"{name}: acquisition not found")
            continue
        try:
            after = {identity(x) for x in analyze(new, config=config) if x["confidence"] == "definite"}
        except SyntaxError:
            rejected.append(f"{name}: the edit does not parse")
            continue
        before = {identity(x) for x in findings if x["confidence"] == "definite"}
        if identity(f) in after:
            rejected.append(f"{name}: the finding remains")
        elif after - before:
            rejected.append(f"{name}: the edit makes a new finding")
        else:
            source = new
            applied.append(name)


def scout(source: str, config: Config | None = None) -> list[tuple[int, str, str]]:
    """(line, variable, rule) of acquisitions that no with statement of their function is about."""
    from tributary.functions.liveness import Unit

    unit = Unit(source, config or Config())
    out = []
    for scope in [unit.tree, *unit.defs]:
        nodes = list(cf.own_nodes(scope))
        held = {a.id for n in nodes if isinstance(n, ast.With | ast.AsyncWith) for i in n.items for a in ast.walk(i.context_expr) if isinstance(a, ast.Name)}
        for n in nodes:
            var, value = target_of(n) if isinstance(n, ast.stmt) else (None, None)
            if var and isinstance(value, ast.Call) and var not in held and (spec := unit.acquires(unit.name(value))):
                out.append((n.lineno, var, spec.acquire))
    return sorted(out)
