"""One source as one document: findings, blocks with their tags, syntax tree, fix and second opinions."""

from __future__ import annotations

import ast

from tributary.functions import flow as cf
from tributary.functions import liveness, rewrite
from tributary.functions.specs import Config

#: The rule that all findings are of.
RULE = "LEAK001"


def record(f: dict) -> dict:
    """A finding as a record of twenty fields."""
    names = ("severity", "confidence", "resource_type", "file", "func", "line", "col", "var", "acquire", "release", "message", "acquire_line", "kind", "leaking_paths", "safe_paths", "exception_note", "cleanup_line", "fixability")
    return {"rule": RULE} | {n: f[n] for n in names} | {"cleanup_line": f["cleanup_line"] or None, "leak_reasons": f["reasons"]}


def acquisitions(unit: liveness.Unit) -> list[dict]:
    """Acquiring assignments, once for each variable and line, names resolved through the imports."""
    out: dict[tuple[str, int], dict] = {}
    for n in ast.walk(unit.tree):
        var, value = liveness.target_of(n) if isinstance(n, ast.stmt) else (None, None)
        if var and isinstance(value, ast.Call) and (spec := unit.acquires(unit.name(value))):
            out.setdefault((var, n.lineno), {"var": var, "acquire": spec.acquire, "release": spec.release, "line": n.lineno})
    return sorted(out.values(), key=lambda r: (r["line"], r["var"]))


def tags(findings: list[dict], func: str) -> tuple[set[int], set[int]]:
    """Blocks of a function on leaking paths, and those on safe paths only."""
    mine = [f for f in findings if f["func"] == func]
    leak = {b for f in mine for p in f["leaking_paths"] for b in p}
    return leak, {b for f in mine for p in f["safe_paths"] for b in p} - leak


def graph(name: str, body: list[ast.stmt], findings: list[dict]) -> dict:
    """Blocks and labelled edges of a function; blocks without statements are not listed, but for the entry."""
    blocks = cf.Flow(body).blocks
    leak, safe = tags(findings, name)
    rows, edges = [], []
    for i, b in enumerate(blocks):
        lines = [x.lineno for x in b.items]
        if b.items or i == 0:
            rows.append({"id": i, "statements": [ast.unparse(x).splitlines()[0][:80] for x in b.items], "line_start": min(lines, default=None), "line_end": max(lines, default=None), "is_entry": i == 0, "is_exit": not b.exits, "tag": "leak" if i in leak else "safe" if i in safe else None})
        edges += [{"from": i, "to": d, "label": x} for (d, _), x in zip(b.exits, cf.exit_labels([g for _, g in b.exits]))]
    return {"name": name, "blocks": rows, "edges": edges, "leak_blocks": sorted(leak), "safe_blocks": sorted(safe), "has_leak": bool(leak)}


def opinions(scouted: list[tuple[int, str, str]], findings: list[dict], acquires: list[dict]) -> list[dict]:
    """What the analyzer says about each scouted line."""
    kinds: dict[int, str] = {}
    for f in findings:
        kinds.setdefault(f["acquire_line"], f["kind"])
    seen = {a["line"] for a in acquires}
    verdict = lambda n: ("confirmed_exception_unsafe" if kinds[n] == "exception" else "confirmed_path_leak") if n in kinds else "refuted_safe" if n in seen else "unverified"
    return [{"line": n, "var": v, "rule": r, "verdict": verdict(n)} for n, v, r in scouted]


def document(source: str, filename: str = "<string>", config: Config | None = None) -> dict:
    """Everything about a source; raises SyntaxError for what is no Python. It holds no clock, so equal sources agree."""
    config = config or Config()
    unit = liveness.Unit(source, config)
    findings = liveness.analyze(source, filename, config)
    acquires = acquisitions(unit)
    top = [s for s in unit.tree.body if not isinstance(s, cf.SCOPES)]
    graphs = [graph(d.name, d.body, findings) for d in unit.defs] + ([graph("<module>", top, findings)] if top else [])
    new, applied, rejected = rewrite.fix(source, config)
    steps = [("parse", f"{sum(1 for _ in ast.walk(unit.tree))} nodes"), ("imports", f"{len(unit.imports)} names"), ("control flow", f"{len(graphs)} graphs"), ("resources", f"{len(acquires)} acquired"), ("effects", f"{len(unit.defs)} functions"), ("paths", f"{len(findings)} findings"), ("fix", f"{len(applied)} applied")]
    return {
        "ok": True, "filename": filename,
        "summary": {"leak_count": len(findings), "path_leaks": sum(f["kind"] != "exception" for f in findings), "exception_leaks": sum("exception" in f["kind"] for f in findings), "acquires": len(acquires), "functions_analyzed": len(graphs), "trajectory_steps": len(steps)},
        "leaks": [record(f) for f in findings],
        "trajectory": [{"step": k, "title": t, "detail": x} for k, (t, x) in enumerate(steps, 1)],
        "ast": [dict(zip(("node", "parent", "depth", "type", "line"), r)) for r in cf.ast_rows(unit.tree)],
        "cfg": {"functions": graphs},
        "fix": {"source": new if applied else None, "applied": applied, "rejected": rejected},
        "ensemble": opinions(rewrite.scout(source, config), findings, acquires),
        "knowledge_base": {"specs": len(config.specs), "contracts": len(config.contracts)},
    }
