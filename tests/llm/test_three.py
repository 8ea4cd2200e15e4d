"""Odd sketches, the audit of filters and fill-in-middle against brute force, and on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import audit, middle, ngram_join, odd_sketch

SCHEMA = "doc_id bigint, text string, lang string"


def table(spark, texts, langs=("en", "de", None)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)]) for i, t in enumerate(texts, 1)], SCHEMA)


def varied(rng, n=60):
    """Originals, exact copies, chains of near copies (some on either side of the threshold) and texts of few words."""
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(1, 6)):
                if words:
                    words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"W{rng.randrange(400)}" for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 60, 120)))))
    return texts


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i) + 1) for i, s in enumerate(sets)]


def chain(rng, steps=30):
    """Texts of small steps, whose ends have little in common: a star leaves most of them apart."""
    words, texts = [f"w{i}" for i in range(100)], []
    for k in range(steps):
        words[rng.randrange(100)] = f"n{k}"
        texts.append(" ".join(words))
    return texts


def test_components_against_brute_force(spark, monkeypatch):
    for name, most in (("PART", 3), ("STAR", 2), ("BLOCK", 8)):
        monkeypatch.setattr(odd_sketch, name, most)
    texts = varied(random.Random(5), 120) + chain(random.Random(3))
    got = {r["doc_id"]: r for r in odd_sketch.components(table(spark, texts)).collect()}
    want = brute_components(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(1, len(texts) + 1)] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert len({c for _, c in want[120:]}) < 5 and len({c for _, c in want}) < 100


def test_estimates_of_odd_sketches():
    rng = np.random.default_rng(8)
    for similarity in (0.8, 0.9, 0.95):
        found = []
        for _ in range(200):
            a = rng.integers(0, 2**63, 800).astype(np.uint64)
            k = round(1600 * similarity / (1 + similarity))
            b = np.concatenate([a[:k], rng.integers(0, 2**63, 800 - k).astype(np.uint64)])
            x, y = (np.frombuffer(odd_sketch.sketch(ngram_join.minhash(np.unique(s))), np.uint64) for s in (a, b))
            found.append(np.bitwise_count(x ^ y).sum())
        assert max(found) <= odd_sketch.LOOSE
        assert abs(odd_sketch.estimate(np.array(found)).mean() - similarity) < 0.01


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    failed = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        failed.append(f)
    out = {}
    for part in {x[2] or "" for x in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [k for k, x in enumerate(rows) if (x[2] or "") == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [k for k in left if letter in failed[k]]
                redundant = [k for k in gone if letter in failed[k]]
                left = [k for k in left if letter not in failed[k]]
                gone += removed
                unique = sum(f == {letter} for f, x in zip(failed, rows) if (x[2] or "") == part)
                quality = [sum(any(y[m] == 1 for y in labels if y[0] == rows[k][0]) for k in removed) for m in (1, 2)]
                out[part, order, step] = [len(left), len(removed), len(redundant), unique, *quality]
                shapley[letter] += len(removed)
        for order, step in [(o, s) for p, o, s in out if p == part]:
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "A", "a" * 30, "a #"]
    for _ in range(40):
        words = [rng.choice(("Word", "w", "ünï")) + str(rng.randrange(rng.choice((40, 400)))) for _ in range(rng.choice((10, 199, 200, 260)))]
        texts.append(rng.choice((" ", "\n", "\t\r")).join(words) + rng.choice(("", "", " |", " \n")))
        texts += [texts[-1]] * (rng.random() < 0.3)
    rows = [(i, t, rng.choice(("en", "de", None))) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[9], "en"), (None, None, "de"), (rows[9][0], texts[12], "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = audit.interactions(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r[0], r[1], r[2]): [*r[3:]] for r in got} == brute_audit(rows, [x for x in labels if x[0] is not None])


def brute_middle(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "x", "no <P> cut", "ends with <", "<S", "a<S b", "line\r\nbreaks\x00", "ünï 世界 😀 z", "word " * 30_000, "w" * 200_000]
    texts += ["".join(rng.choice(("word", " ", "Ab", "é", "😀", "\n", "<", "P", ">", "1")) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id has a text"), (None, None), (7, texts[7]), (7, texts[7]), (7, "same id, other text")]
    got = middle.transform(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id", "text"]).withColumn("back", middle.restored())
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == sorted(((i, t, *brute_middle(i, t), t or "") for i, t in rows), key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_empty_tables_and_clashing_names(spark):
    names = ["n", "Form", "output", "n_shingles", "Component_ID", "kept", "part", "filter_order", "step", "a.b", "__key", "rid"]
    docs = table(spark, ["one two three four five", "", None, "one two three four five"]).select("*", *[F.lit("x").alias(x) for x in names])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert sorted(r["component_id"] for r in odd_sketch.components(docs).collect()) == [1, 1, 2, 3]
    assert audit.interactions(docs, labels).count() == 3 * 600
    out = middle.transform(docs, ["doc_id", "n", "Form", "a.b", "__key"])
    assert out.columns == ["doc_id", "a.b", "__key", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 4
    none = docs.where("false")
    assert odd_sketch.components(none).collect() == middle.digests(none).collect() == audit.interactions(none, labels).collect() == []


def test_audit_broadcasts_no_salted_rows(spark, tmp_path):
    # a small file of many labels, which the join with the documents repeats for each salt
    spark.range(40_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels")
    spark.createDataFrame([(i, f"word {i}", "en", "s", 6) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/docs")
    df = audit.interactions(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"))
    rows = df.where("filter_order = 'ABCDE' and step = 1").select("removed", "good_lost", "toxic_lost").collect()
    assert [tuple(r) for r in rows] == [(20, 20, 0)]
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
