"""Labelled sources: what is published about each case, and the pinned patterns, as templates.

{f}, {v} and {n} stand for a function name, a variable and a number, so that a template gives any number of sources.
"""

from __future__ import annotations

#: (name, label of the case, verdict that an analyzer must give, kinds of its findings, template)
TEMPLATES: list[tuple[str, str, str, int, str]] = [
    ("simple", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    data = {v}.read()\n    return data\n"),
    ("early_return", "leak", "leak", 1, "def {f}(path, bad):\n    {v} = open(path)\n    if bad:\n        return {n}\n    data = {v}.read()\n    {v}.close()\n    return data\n"),
    ("loop", "leak", "leak", 1, "def {f}(paths):\n    got = []\n    for p in paths:\n        {v} = open(p)\n        got.append({v}.read())\n        if len(got) > {n}:\n            return got\n        {v}.close()\n    return got\n"),
    ("handler_returns", "leak", "potential", 1, "def {f}(path):\n    {v} = open(path)\n    try:\n        work({v})\n    except Exception:\n        return {n}\n    {v}.close()\n"),
    ("handler_calls", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    try:\n        work({v})\n    except Exception:\n        note({n})\n    {v}.close()\n"),
    ("two_handles", "leak", "leak", 2, "def {f}(a, b):\n    {v} = open(a)\n    w = open(b)\n    try:\n        x = {v}.read()\n        y = w.read()\n        if not x:\n            return y\n    except Exception:\n        {v}.close()\n        return None\n    {v}.close()\n    return x + y\n"),
    ("overwritten", "leak", "leak", 1, "def {f}(a, b):\n    {v} = open(a)\n    {v} = open(b)\n    x = {v}.read()\n    {v}.close()\n    return x\n"),
    ("helper_may_close", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    use_{f}({v})\n    return {n}\n\ndef use_{f}(h):\n    x = h.read()\n    if 'no' in x:\n        return x\n    h.close()\n    return x\n"),
    ("socket", "leak", "leak", 1, "import socket\ndef {f}():\n    {v} = socket.socket()\n    {v}.connect(('host', {n}))\n    if check():\n        return 1\n    {v}.close()\n    return 2\n"),
    ("database", "leak", "leak", 1, "import sqlite3 as db\ndef {f}(path):\n    {v} = db.connect(path)\n    cur = {v}.cursor()\n    if check():\n        return None\n    cur.execute('select {n}')\n    {v}.close()\n    return 2\n"),
    ("finally_closes", "safe", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    try:\n        return {v}.read({n})\n    finally:\n        {v}.close()\n"),
    ("with", "safe", "safe", 0, "def {f}(path):\n    with open(path) as {v}:\n        return {v}.read({n})\n"),
    ("nested_with", "safe", "safe", 0, "def {f}(a, b):\n    with open(a) as {v}:\n        with open(b) as w:\n            return {v}.read() + w.read({n})\n"),
    ("with_in_loop", "safe", "safe", 0, "def {f}(paths):\n    got = []\n    for p in paths:\n        with open(p) as {v}:\n            got.append({v}.read({n}))\n    return got\n"),
    ("tangle", "leak", "leak", 1, "def {f}(paths, stop):\n    for p in paths:\n        {v} = open(p)\n        try:\n            x = {v}.read({n})\n            if stop(x):\n                return x\n            if not x:\n                continue\n            work({v})\n        except Exception:\n            note()\n        if done(x):\n            {v}.close()\n    return None\n"),
    ("alias", "safe", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    w = {v}\n    w.close()\n    return {n}\n"),
    ("returned", "potential", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    return {v}\n"),
    ("second_raises", "leak", "leak", 1, "def {f}(a, b):\n    {v} = open(a)\n    w = open(b)\n    {v}.close()\n    w.close()\n    return {n}\n"),
    ("read_close", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    {v}.read({n})\n    {v}.close()\n"),
    ("process_waits", "safe", "safe", 0, "import subprocess\ndef {f}(cmd):\n    {v} = subprocess.Popen(cmd)\n    {v}.wait()\n    return {n}\n"),
    ("helper_closes", "safe", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    end_{f}({v})\n    return {n}\n\ndef end_{f}(h):\n    h.close()\n"),
    ("unknown_callee", "potential", "potential", 1, "def {f}(path):\n    {v} = open(path)\n    elsewhere({v}, {n})\n"),
    ("closing", "safe", "safe", 0, "import contextlib\ndef {f}(path):\n    {v} = open(path)\n    with contextlib.closing({v}):\n        return {v}.read({n})\n"),
    ("exit_stack", "safe", "safe", 0, "import contextlib\ndef {f}(path):\n    with contextlib.ExitStack() as stack:\n        {v} = stack.enter_context(open(path))\n        return {v}.read({n})\n"),
    ("module_level", "leak", "leak", 1, "{v} = open('x{n}')\ndata = {v}.read()\n"),
    ("keyword_only", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    elsewhere(h={v}, n={n})\n"),
    ("returned_tuple", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    return ({v}, {n})\n"),
    ("with_handle", "safe", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    with {v}:\n        return {v}.read({n})\n"),
    ("loop_continue", "leak", "leak", 1, "def {f}(paths):\n    for p in paths:\n        {v} = open(p)\n        if p == {n}:\n            continue\n        {v}.close()\n"),
    ("match_case", "leak", "leak", 1, "def {f}(path):\n    {v} = open(path)\n    match path:\n        case {n}:\n            {v}.close()\n        case _:\n            return 2\n"),
    ("temp_dir", "safe", "safe", 0, "import tempfile\ndef {f}():\n    {v} = tempfile.TemporaryDirectory()\n    {v}.cleanup()\n    return {n}\n"),
    ("many_branches", "leak", "leak", 1, "def {f}(x):\n    {v} = open(x)\n" + "".join(f"    if x > {i}:\n        y = {i}\n" for i in range(9)) + "    return {n}\n"),
    ("helper_picks", "potential", "safe", 0, "def {f}(path, c):\n    {v} = open(path)\n    return pick_{f}({v}, c)\n\ndef pick_{f}(h, c):\n    if c:\n        return h\n    return {n}\n"),
    ("helper_names", "potential", "safe", 0, "def {f}(path):\n    {v} = open(path)\n    return name_{f}({v})\n\ndef name_{f}(h):\n    return [h.name, {n}]\n"),
    ("server_loop", "leak", "leak", 1, "def {f}(x):\n    while True:\n        {v} = open(x)\n" + "".join(f"        if x > {i}:\n            y = {i}\n" for i in range(90))),
    ("one_line", "leak", "leak", 1, "def {f}(a, b):\n    {v} = open(a); w = open(b)\n    return {n}\n"),
    ("in_try", "leak", "leak", 1, "def {f}(path):\n    try:\n        {v} = open(path)\n        x = {v}.read()\n    except OSError:\n        return {n}\n    return x\n"),
    ("known_by_rule", "leak", "safe", 0, "import vault\ndef {f}(name):\n    {v} = vault.checkout(name)\n    return {n}\n"),
    ("syntax_error", "safe", "error", 0, "def {f}(path:\n    {v} = open(path)\n"),
]

#: A knowledge base that knows what the default specs do not.
KNOWLEDGE = """
resources:
- {call: vault.checkout, close: [checkin, drop]}
- {call: open, close: [never]}
- not a rule
api_contracts:
- {library: builtins, function: elsewhere, behavior: CLOSES_INPUT, exception_safety: GUARANTEED}
"""

#: The first eighteen are cases of the published benchmark's kinds.
LABELLED = 18


def source(i: int, n: int) -> str:
    return TEMPLATES[i][4].format(f=f"fn{n}", v=f"h{n % 7}", n=n)
