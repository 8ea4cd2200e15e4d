"""The index of trigrams and the join of dotted names."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import contracts, trigrams


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, rng.choice((None, "", "ab", "".join(rng.choices("abAB ", k=rng.randrange(40))))), "".join(rng.choices("xyÜ", k=rng.randrange(9)))) for i in range(3000)]
    return made, spark.createDataFrame(made, "id bigint, text string, other string")


def test_search_against_a_scan(spark, rows, monkeypatch):
    made, df = rows
    monkeypatch.setattr(trigrams, "PART_ROWS", 100)
    index = trigrams.build(df, "id", {"text": F.col("text"), "other": F.col("other")})
    assert index.parts == 30
    has = lambda t, n: n.lower() in (t or "").lower()
    for clauses in ([[("text", "aBba")]], [[("text", "abab a")], [("other", "xyx"), ("other", "YÜx")]], [[("text", "b")], [("other", "yyyy")]], [[("text", "ab")]], [[("text", "")]], [[("text", "no such text")]], [[("text", "baa"), ("other", "y")]], [[]], []):
        for named in (2000, 3):
            monkeypatch.setattr(trigrams, "NAMED_PARTS", named)
            got = index.search(clauses)
            want = [r for r in made if all(any(has(r[1 if f == "text" else 2], n) for f, n in c) for c in clauses)]
            assert sorted(map(tuple, got.collect())) == sorted(want), clauses
    assert got.columns == ["id", "text", "other"]


def test_a_search_reads_its_grams_and_the_parts_with_candidates(spark, rows, monkeypatch):
    _, df = rows
    monkeypatch.setattr(trigrams, "PART_ROWS", 100)
    odd = df.withColumn("text", F.when(F.col("id") == 77, "one single needle").otherwise(F.col("text")))
    index = trigrams.build(odd, "id", {"text": F.col("text")})
    plan = index.search([[("text", "needle")]])
    assert [r["id"] for r in plan.collect()] == [77]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text or "PartitionFilters: [(part" in text
    read = spark.read.parquet(f"{index.place}/rows").where(F.col("part").isin([r["part"] for r in index.candidates([[("text", "needle")]]).collect()]))
    assert len(read.inputFiles()) >= 1 and read.count() < 300
    assert "PushedFilters: [In(gram" in index.candidates([[("text", "needle")]])._jdf.queryExecution().executedPlan().toString()


def test_names_and_specs_by_dotted_suffixes(spark):
    rng = random.Random(7)
    word = lambda: ".".join(rng.choice(("a", "b", "open", "connect")) for _ in range(rng.randrange(1, 4)))
    calls = [(i, f"m{i}.open" if i % 10 else word()) for i in range(400)]  # nine of ten end in one segment
    specs = [(word(), f"close{k}", k) for k in range(25)] + [("x.m5.open", "close", 99)]
    fits = lambda c, a: c == a or c.endswith(f".{a}") or a.endswith(f".{c}")
    df, sp = spark.createDataFrame(calls, "id int, resolved string"), spark.createDataFrame(specs, "acquire string, release string, pos int")
    want = {i: [s for s in specs if fits(c, s[0])] for i, c in calls}
    got = {r["id"]: (r["acquire"], r["release"]) for r in contracts.matched(df, sp).collect()}
    assert got == {i: min(m, key=lambda s: s[2])[:2] for i, m in want.items() if m}
    assert {r["id"]: r["specs"] for r in contracts.match_counts(df, sp).collect()} == {i: len(m) for i, m in want.items() if m}
