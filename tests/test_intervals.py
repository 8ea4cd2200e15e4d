"""Points and intervals by bins of two widths, against a plain search."""

import random

from pyspark.sql import functions as F

from tributary.operators import graphs, intervals


def test_against_a_plain_search(spark):
    rng = random.Random(12)
    spans = [("u1" if rng.random() < 0.9 else "u2", f"f{i}", a, a + rng.choice((-1, 0, 1, 40, 511, 512, 700, 9000))) for i, a in enumerate(rng.randrange(-50, 9000) for _ in range(300))]
    spans += [(None, "no unit", 0, 9000), ("u1", "open", 5, None)]
    points = [(i, rng.choice(("u1", "u2", "u3", None)), rng.choice((None, rng.randrange(-60, 9500)))) for i in range(800)] + [(900, "u1", 3), (901, "u1", 3)]
    p = spark.createDataFrame(points, "id int, unit string, line int")
    s = spark.createDataFrame(spans, "unit string, func string, first int, last int")
    around = {i: [(b - a, f) for u, f, a, b in spans if u and u == unit and x is not None and b is not None and a <= x <= b] for i, unit, x in points}
    got = {r["id"]: r["func"] for r in intervals.narrowest(p, s, ["unit"], "line", "first", "last", "func").collect()}
    assert got == {i: min(f)[1] if f else None for i, f in around.items()}
    out = [r["id"] for r in intervals.outside(p, s, ["unit"], "line", "first", "last").collect()]
    assert sorted(out) == sorted(i for i, f in around.items() if not f)


def test_a_unit_of_many_lines_and_functions_stays_in_small_bins(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit("u").alias("unit"), F.col("id").alias("line"))
    small = spark.range(n).select(F.lit("u").alias("unit"), F.concat(F.lit("f"), "id").alias("func"), F.col("id").alias("first"), (F.col("id") + 2).alias("last"))
    large = spark.range(20).select(F.lit("u").alias("unit"), F.concat(F.lit("g"), "id").alias("func"), (F.col("id") * 10 - 100).alias("first"), F.lit(n + 50).cast("bigint").alias("last"))
    functions = small.unionByName(large)
    per_bin = functions.select(F.explode(intervals.bins("first", "last")).alias("b")).groupBy("b").count()
    assert per_bin.agg(F.max("count")).first()[0] <= intervals.NARROW + 2  # besides, a bin has its width of lines at most
    got = graphs.enclosing(lines, functions)
    want = F.concat(F.lit("f"), F.least(*[F.concat(F.greatest(F.col("line") - k, F.lit(0)).cast("string")) for k in range(3)]))
    assert got.count() == n and got.where(F.col("func") != want).count() == 0
