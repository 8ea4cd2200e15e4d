"""The table of results by content: hits, misses, eviction, and each content analyzed once."""

import hashlib
import random

from pyspark.sql import functions as F

from tributary.operators import engine, memo

COMPUTE = lambda c: c.select("key", F.length("text").alias("n"))


def key(text):
    return hashlib.sha256(f"\n{text}".encode()).hexdigest()


def test_runs_against_a_plain_table(spark):
    rng = random.Random(4)
    table, plain = None, {}
    for epoch in range(5):
        texts = [f"t{rng.randrange(60)}" for _ in range(rng.choice((0, 40, 80)))] + [None] * 2
        got = memo.run(table, spark.createDataFrame([*enumerate(texts)], "id int, text string"), epoch, COMPUTE, 25)
        asked = {key(t): len(t) for t in texts if t is not None}
        misses = len(asked.keys() - plain.keys())
        held = plain | {k: (epoch, n) for k, n in asked.items()}
        plain = dict(sorted(held.items(), key=lambda x: (-x[1][0], x[0]))[:25])
        assert {r["id"]: r["n"] for r in got.answers.collect()} == {i: None if t is None else len(t) for i, t in enumerate(texts)}
        assert {r["key"]: (r["epoch"], r["n"]) for r in got.table.collect()} == plain
        c = got.counts.first().asDict()
        assert c == {"epoch": epoch, "requests": len(texts) - 2, "hits": len(texts) - 2 - misses, "misses": misses, "evicted": len(held) - len(plain), "kept": len(plain)}
        table = got.table


def test_keys_of_one_prefix_are_told_apart(spark):
    rows = [("abc" * 20 + f"{i:04x}", 1) for i in range(40)] + [("0" * 64, 0)]
    held = spark.createDataFrame(rows, "key string, epoch int")
    for bound in (0, 1, 39, 40, 41, 50):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:bound]
        assert sorted(map(tuple, memo.evicted(held, bound).collect())) == sorted(want)


def test_a_configuration_has_results_of_its_own_and_each_source_is_analyzed_once(spark):
    leak, safe = "def f(p):\n    g = open(p)\n", "x = 1\n"
    asked = spark.createDataFrame([(1, leak), (2, safe), (3, leak)], "id int, text string")

    def analyze(contents):
        units = contents.select(F.xxhash64("key").alias("unit_id"), F.lit("a.py").alias("path"), F.col("text").alias("source"), "key")
        return engine.verdicts(units.drop("key")).join(units.select("unit_id", "key"), "unit_id").select("key", "verdict")

    first = memo.run(None, asked, 0, analyze, 10)
    assert {r["id"]: r["verdict"] for r in first.answers.collect()} == {1: "leak", 2: "safe", 3: "leak"}
    again = memo.run(first.table, asked, 1, analyze, 10)
    assert (first.counts.first()["misses"], again.counts.first()["misses"]) == (2, 0) and again.answers.count() == 3
    other = memo.run(first.table, asked, 1, analyze, 10, config="strict")
    assert other.counts.first()["misses"] == 2
