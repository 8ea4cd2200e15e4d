"""Every query with an oracle equals it on the smallest tables; the others run."""

import pytest

from tests.conftest import SF
from tributary.plans import registry


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return bytes(x) if isinstance(x, bytearray) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
