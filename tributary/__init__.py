"""tributary: resource-leak analysis and findings analytics on Spark DataFrames."""

from tributary.functions.liveness import analyze as analyze_source
from tributary.functions.specs import DEFAULT_SPECS, Config
from tributary.functions.specs import Spec as ResourceSpec

__version__ = "0.2.0"

DEFAULT_RESOURCES = [ResourceSpec(*s) for s in DEFAULT_SPECS]


def analyze_file(path: str, config: Config | None = None) -> list[dict]:
    """Findings of one file; raises SyntaxError for what is no Python."""
    with open(path, encoding="utf-8") as f:
        return analyze_source(f.read(), path, config)


def register(spark, config: Config | None = None, name: str = "leak_findings") -> None:
    """Registers the analyzer as a table function of a source, for use in SQL."""
    from tributary.operators import engine

    engine.register(spark, name, config)


__all__ = ["DEFAULT_RESOURCES", "Config", "ResourceSpec", "analyze_file", "analyze_source", "register"]
