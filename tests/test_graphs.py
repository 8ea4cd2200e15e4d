"""Bounded enumeration of paths."""

import random

from tributary.operators import graphs


def plain(edges, cap):
    """The first paths of a depth-first walk, and whether there were more."""
    after = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    out, todo = [], [[0]] if 0 in after else []
    while todo:
        path = todo.pop()
        if path[-1] not in after:
            out.append(path)
        todo += [[*path, x] for x in reversed(after.get(path[-1], ())) if x not in path]
    return out[:cap], len(out) > cap


def test_first_paths_are_those_of_a_walk(spark):
    rng = random.Random(5)
    units = {0: [(3 * i + a, 3 * i + b) for i in range(14) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]}  # 16,384 paths
    for u in range(1, 6):
        units[u] = [tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)]
    units[6] = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3)]
    units[7] = [(1, 2)]
    df = spark.createDataFrame([(u, a, b) for u, e in units.items() for a, b in e], "unit int, src int, dst int")
    got = {}
    for r in graphs.first_paths(df, 20).collect():
        got.setdefault(r["unit"], []).append((r["path"], r["truncated"]))
    for u, e in units.items():
        want, more = plain(e, 20)
        assert sorted(got.get(u, [])) == [(p, more) for p in want], u


def test_layers_of_a_deep_graph_leave_few_tables(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FOLD", 3)
    places = []
    monkeypatch.setattr(graphs.rounds, "written", lambda df, place, f=graphs.rounds.written: (places.append(place), f(df, place))[1])
    deep = 14
    edges = [(1, i, i + 1) for i in range(deep)] + [(1, 5, 2), (1, 0, 3), (2, 0, 1), (2, 1, 0), (3, 4, 5)]
    nodes = spark.createDataFrame([(1, i) for i in range(deep + 3)] + [(2, 0), (2, 1), (2, 2), (3, 4)], "unit int, node bigint")
    got = {(r["unit"], r["node"]): r["layer"] for r in graphs.layers(spark, nodes, spark.createDataFrame(edges, "unit int, src bigint, dst bigint")).collect()}
    want = {(1, i): i if i < 3 else i - 2 for i in range(deep + 1)}
    assert got == want | {(1, deep + 1): deep - 1, (1, deep + 2): deep - 1, (2, 0): 0, (2, 1): 1, (2, 2): 2}
    folder = spark._jvm.org.apache.hadoop.fs.Path(places[0].rpartition("/")[0])
    left = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    assert len(places) > deep and len(left) <= graphs.FOLD + 3


def test_first_paths_broadcast_no_edges_and_leave_one_table(spark, tmp_path, monkeypatch):
    # edges made from a small file of few columns, many from each of its rows
    places, plans = [], []

    def written(df, place, f=graphs.rounds.written):
        places.append(place)
        out = f(df, place)
        plans.append(df._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(graphs.rounds, "written", written)
    spark.range(50).write.parquet(f"{tmp_path}/units")
    links = "explode(array(struct(0 as a, 1 as b), struct(0 as a, 2 as b), struct(1 as a, 3 as b), struct(2 as a, 3 as b))) as l"
    edges = spark.read.parquet(f"{tmp_path}/units").selectExpr("id as unit", "explode(sequence(0, 5)) as i").selectExpr("unit", "i", links).selectExpr("unit", "3 * i + l.a as src", "3 * i + l.b as dst")
    got = graphs.first_paths(edges, 20)
    want, more = plain([(3 * i + a, 3 * i + b) for i in range(6) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))], 20)
    assert sorted((r["unit"], r["path"], r["truncated"]) for r in got.collect()) == [(u, p, more) for u in range(50) for p in want]
    assert len(plans) > 12 and not any("BroadcastHashJoin" in p for p in plans)
    folder = spark._jvm.org.apache.hadoop.fs.Path(places[0].rpartition("/")[0])
    assert len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)) == 1
