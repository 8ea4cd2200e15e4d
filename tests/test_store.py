"""Merging, sources and the streaming store."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import SF
from tributary.operators import engine, merge
from tributary.plans import views
from tributary.sources import files, records
from tributary.streaming import store


def test_upsert_twice_is_once(spark):
    from tributary.plans import q_store

    stored = q_store.stored(spark, SF).drop("login", "repo", "source")
    batch = q_store.batch(spark, SF)
    once = merge.upsert(stored, batch, views.AS_OF)
    twice = merge.upsert(once, batch, views.AS_OF)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def plain_store(batches):
    """The store after batches of (login, repo, source, finding, level, time), row by row."""
    stored = {}
    for batch in batches:
        new = {}
        for *scope, i, level, t in sorted(batch, key=lambda r: r[-1]):
            first = new.get((tuple(scope), i), (level, t, t))[1]
            new[tuple(scope), i] = (level, first, t)
        touched = {s for s, _ in new}
        kept = {k: r for k, r in stored.items() if k[0] not in touched or k in new}
        stored = kept | {k: (r[0], min(r[1], kept.get(k, r)[1]), max(r[2], kept.get(k, r)[2])) for k, r in new.items()}
    return stored


def batch_of(spark, rows):
    day = F.to_timestamp_ntz(F.date_add(F.lit("2024-01-01"), F.col("t")).cast("string"))
    rows = [(*r, k) for k, r in enumerate(rows)]
    made = spark.createDataFrame(rows, "login string, repo string, source string, line int, level string, t int, event_id bigint")
    nothing = [F.lit("").alias(c) for c in ("branch", "path", "func", "sha")]
    return made.select("*", *nothing, F.lit("title").alias("title"), day.alias("found_at"))


def test_store_equals_rows_taken_one_by_one(spark, tmp_path):
    rng = random.Random(6)
    batches = []
    for _ in range(11):
        logins = rng.sample(["o1", "o2", "o3", "o4"], rng.randrange(5))
        batches.append([(x, f"{x}/r{rng.randrange(2)}", "ci", rng.randrange(6), rng.choice(("error", "notice")), rng.randrange(300)) for x in logins for _ in range(6)])
        batches[-1] = [*{r[-1]: r for r in batches[-1]}.values()]
    out, compactions = str(tmp_path / "out"), 0
    for b, rows in enumerate(batches):
        before = store.manifest(spark, out, b - 1)
        after = store.write(spark, out, b, batch_of(spark, rows))
        assert store.write(spark, out, b, batch_of(spark, rows)).deltas == after.deltas  # a repeated batch
        compactions += after.base == b
        if b in (0, 1, 3, 6, 8, 10):
            got = {((r["login"], r["repo"], r["source"]), r["_id"]): (r["level"], r["first_seen"], r["last_seen"]) for r in store.current(spark, out, b).collect()}
            day = lambda t: datetime(2024, 1, 1) + timedelta(days=t)
            want = {(k, f"{k[1]}||ci||{i}||"): (r[0], day(r[1]), day(r[2])) for (k, i), r in plain_store(batches[: b + 1]).items()}
            assert got == want, b
            recount = store.current(spark, out, b).groupBy("repo", "branch", "source", "level", F.to_date("last_seen").alias("day")).agg(F.count("*").alias("n"))
            assert sorted(map(tuple, store.counts(spark, out, b).collect())) == sorted(map(tuple, recount.collect()))
    assert compactions >= 2
    there = {f"{x.parent.name}/{x.name}" for x in (tmp_path / "out").glob("*/v=*")}
    assert there == after.folders() | before.folders() | {f"manifest/v={b}" for b in (8, 9, 10)}  # nothing else is left


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    rows = [("o", f"o/r{i % 50}", "ci", i, "error", i % 300) for i in range(40_000)]
    store.write(spark, out, 0, batch_of(spark, rows[:10]))
    monkeypatch.setattr(store, "BUCKET_BYTES", 40_000)
    base = store.write(spark, out, 1, batch_of(spark, rows))
    assert base.base == 1 and base.deltas == () and base.buckets > 4
    after = store.write(spark, out, 2, batch_of(spark, rows[:20]))
    assert after.base == 1 and after.deltas == (2,) and after.log_bytes < 0.1 * base.base_bytes
    assert store.size(spark, f"{out}/log/v=2") == after.log_bytes


def test_a_hot_scope_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_BYTES", 14_000)
    out = str(tmp_path / "out")
    rows = [("o", "o/hot" if i % 10 else f"o/r{i % 70}", "ci", i, "error", i % 300) for i in range(20_000)]
    store.write(spark, out, 0, batch_of(spark, rows[:100]))
    m = store.write(spark, out, 1, batch_of(spark, rows))
    parts = spark.read.parquet(f"{out}/base/v=1/rows").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("repo") == "o/hot").alias("hot")).collect()
    assert m.buckets >= 8 and sum(r["hot"] for r in parts) == 18_000 and max(r["n"] for r in parts) < 3 * 20_000 / m.buckets


def test_daily_windows_of_a_stream(spark, tmp_path):
    f = views.findings(spark, SF)
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    q = store.daily(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").agg(F.sum("total")).first()[0] == f.count()


def test_files_are_collected_once_each(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("def g(p):\n    f = open(p)\n")
    (tmp_path / "a/y.txt").write_text("no")
    got = files.collect(spark, [str(tmp_path), str(tmp_path / "a")])
    assert got.count() == 1
    found = engine.findings(got.select(F.lit(1).alias("unit_id"), "path", "source"))
    assert [r["confidence"] for r in found.collect()] == ["definite"]


def test_a_source_that_does_not_parse_is_a_row(spark):
    u = engine.from_texts(spark, [(1, "a.py", "def ("), (2, "b.py", ""), (3, "c.py", None)])
    got = {r["unit_id"]: r["verdict"] for r in engine.verdicts(u).collect()}
    assert got == {1: "error", 2: "safe", 3: "safe"}


def test_requests(spark):
    rows = spark.createDataFrame([(1, '{"source": "x"}'), (2, '{"source": " "}'), (3, "no json"), (4, None)], "id int, body string")
    assert [r["status"] for r in records.requests(rows, "body").orderBy("id").collect()] == [200, 400, 400, 400]
