"""Resource specs, contracts and configuration; all of them are inputs that an analysis never changes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

#: Acquiring call, releasing method, other releasing methods.
DEFAULT_SPECS = [
    ("open", "close", ()),
    ("io.open", "close", ()),
    ("tempfile.NamedTemporaryFile", "close", ()),
    ("tempfile.TemporaryFile", "close", ()),
    ("tempfile.TemporaryDirectory", "cleanup", ()),
    ("socket.socket", "close", ()),
    ("socket.create_connection", "close", ()),
    ("socket.socketpair", "close", ()),
    ("sqlite3.connect", "close", ()),
    ("psycopg2.connect", "close", ()),
    ("psycopg.connect", "close", ()),
    ("pymysql.connect", "close", ()),
    ("mysql.connector.connect", "close", ()),
    ("pymongo.MongoClient", "close", ()),
    ("requests.Session", "close", ()),
    ("httpx.Client", "close", ()),
    ("httpx.AsyncClient", "aclose", ()),
    ("subprocess.Popen", "wait", ("kill", "terminate", "poll")),
    ("multiprocessing.Process", "join", ("terminate", "kill")),
]

#: Builtins that are taken not to raise.
PURE = {
    "print", "range", "len", "int", "str", "float", "bool", "bytes", "list", "dict", "set", "tuple", "frozenset", "isinstance", "issubclass", "sorted", "reversed", "enumerate", "zip",
    "map", "filter", "min", "max", "sum", "abs", "round", "repr", "hash", "id", "type", "super", "ord", "chr", "divmod", "pow", "slice", "staticmethod", "classmethod",
}


@dataclass(frozen=True)
class Spec:
    acquire: str
    release: str
    others: tuple[str, ...] = ()

    def matches(self, name: str) -> bool:
        return name == self.acquire or name.endswith("." + self.acquire) or self.acquire.endswith("." + name)

    @property
    def releases(self) -> tuple[str, ...]:
        return (self.release, *self.others)


@dataclass(frozen=True)
class Contract:
    behavior: str = "UNKNOWN"
    ownership: str = "UNKNOWN"
    exception_safety: str = "UNKNOWN"

    @property
    def ends(self) -> bool:
        """Whether a handle passed in is closed or taken over."""
        return self.behavior in ("CLOSES_INPUT", "TRANSFERS_OWNERSHIP") or self.ownership in ("CONSUME", "TRANSFER")

    @property
    def keeps(self) -> bool:
        return self.behavior == "PRESERVES_INPUT" or self.ownership == "BORROW"

    @property
    def makes(self) -> bool:
        return self.behavior in ("RETURNS_RESOURCE", "CREATES_RESOURCE") or self.ownership == "RETURN"


@dataclass(frozen=True)
class Config:
    specs: tuple[Spec, ...] = tuple(Spec(*s) for s in DEFAULT_SPECS)
    contracts: dict[tuple[str, str], Contract] = field(default_factory=dict)
    exception_safety: bool = True
    path_cap: int = 200
    resolver: object = None  # called with (library, function) for what the contracts lack; off by default

    def contract(self, name: str) -> Contract:
        library, _, function = name.rpartition(".")
        key = (library or "builtins", function)
        found = self.contracts.get(key)
        if found is None and self.resolver is not None:
            found = self.resolver(*key)
        return found or Contract()

    def spec(self, name: str) -> Spec | None:
        return next((s for s in self.specs if s.matches(name)), None)


def from_json(text: str) -> Config:
    """A configuration; an empty list of resources stands for the default one."""
    raw = json.loads(text) if text else {}
    specs = tuple(Spec(r["acquire"], r.get("release", "close"), tuple(r.get("alt_releases", ()))) for r in raw.get("resources") or [])
    return Config(specs or Config().specs, {}, bool(raw.get("exception_safety", True)))


def load_yaml(text: str) -> dict:
    """The mapping of a YAML knowledge base; text that is none, or that does not parse, counts as an empty one."""
    import yaml

    try:
        raw = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return {}
    return raw if isinstance(raw, dict) else {}


def listed(raw: dict, key: str) -> list[dict]:
    """The mappings of a list; entries that are none are dropped."""
    return [x for x in raw.get(key) or [] if isinstance(x, dict)]


def load_contracts(text: str) -> dict[tuple[str, str], Contract]:
    """Contracts of a YAML knowledge base, the first for each library and function."""
    out: dict[tuple[str, str], Contract] = {}
    for c in listed(load_yaml(text), "api_contracts"):
        if c.get("function"):
            out.setdefault((str(c.get("library") or "builtins"), str(c["function"])), Contract(str(c.get("behavior", "UNKNOWN")), str(c.get("ownership", "UNKNOWN")), str(c.get("exception_safety", "UNKNOWN"))))
    return out


def load_rules(text: str) -> list[Spec]:
    """Resource rules of a YAML knowledge base: the call, the releasing methods, the first of them the usual one."""
    out = []
    for r in listed(load_yaml(text), "resources"):
        if r.get("call"):
            close = r.get("close", ["close"])
            close = [close] if isinstance(close, str) else list(close or [])
            others = close[1:] or r.get("alt_releases") or []
            out.append(Spec(str(r["call"]), str(close[0]) if close else "close", tuple(map(str, others))))
    return out


def with_knowledge(config: Config, text: str) -> Config:
    """A configuration that also has the rules and contracts of a knowledge base; what it has already comes first.

    A rule is left out if a spec matches its call. A contract that returns a resource makes a spec in the same way, which
    is released by aclose if its name speaks of async, else by close.
    """
    specs = list(config.specs)
    contracts = load_contracts(text)
    made = [Spec(name, "aclose" if "async" in name.lower() else "close") for (library, function), c in contracts.items() if c.makes for name in [function if library == "builtins" else f"{library}.{function}"]]
    for new in [*load_rules(text), *made]:
        if not any(s.matches(new.acquire) for s in specs):
            specs.append(new)
    return replace(config, specs=tuple(specs), contracts=contracts | config.contracts)
