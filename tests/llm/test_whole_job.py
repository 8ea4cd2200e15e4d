"""Cases in which an operator once did less than the whole job."""

import random

from tributary.llm import brown, crf, lines


def dedupe(spark, texts):
    got = lines.dedupe(spark.createDataFrame([*enumerate(texts, 1)], "doc_id bigint, text string")).collect()
    return {r["doc_id"]: r for r in got}


def test_blocks_of_short_lines_go_whoever_held_their_lines_first(spark):
    block = [f"six words of short line {i}" for i in range(10)]
    odd, even = [f"{x}\nodd filler {i}" for i, x in enumerate(block[::2])], [f"{x}\neven filler {i}" for i, x in enumerate(block[1::2])]
    # every line of B occurs in A (or in one of A1, A2) or B first; C copies B
    got = dedupe(spark, ["\n".join(odd), "\n".join(block), "\n".join(block)])
    assert got[1]["removed_lines"] == got[2]["removed_lines"] == []
    assert got[3]["removed_lines"] == [*range(10)] and got[3]["sources"] == [2] and got[3]["text"] == ""
    got = dedupe(spark, ["\n".join(odd), "\n".join(even), "\n".join(block), "\n".join(["new", *block, "end"])])
    assert got[3]["removed_lines"] == [] and got[4]["text"] == "new\nend" and got[4]["sources"] == [3]


def test_windows_cover_every_block_of_enough_words():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice((1, 2, 3, 6, 12)) for _ in range(rng.randrange(12))]
        made = lines.windows(words, 10)
        assert all(sum(words[x : y + 1]) >= 10 for x, y in made)
        for x in range(len(words)):
            for y in range(x, len(words)):
                covered = {p for a, b in made if x <= a and b <= y for p in range(a, b + 1)}
                assert covered == (set(range(x, y + 1)) if sum(words[x : y + 1]) >= 10 else set())


def test_passages_in_another_order_and_second_copies_go(spark):
    p, q = ("\n".join(f"{name} line {i} of one long passage in ten words" for i in range(6)) for name in "PQ")
    one = "one line of just ten words that is there twice"
    got = dedupe(spark, [f"{p}\nmid\n{q}", f"{q}\nother\n{p}", f"{p}\nbetween\n{p}", f"own\n{one}", f"{one}\nnew\n{one}"])
    assert [got[i]["text"] for i in (2, 3, 5)] == ["other", "between", "new"] and got[2]["sources"] == got[3]["sources"] == [1]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(f"w{i}" for _ in range(rng.choice((1, 2, 4, 6, 11)))) for i in range(14)]
    docs = []
    for _ in range(40):
        lines_of = [x for _ in range(rng.randrange(1, 5)) for x in (lambda a: pool[a : a + rng.randrange(1, 6)])(rng.randrange(14))]
        if docs and rng.random() < 0.5:
            old = rng.choice(docs)
            at = rng.randrange(len(old))
            lines_of[rng.randrange(len(lines_of)) : 0] = old[at : at + rng.randrange(1, 8)]
        docs.append(lines_of)
    got = dedupe(spark, ["\n".join(d) for d in docs])
    seen = set()
    for i, d in enumerate(docs, 1):
        size = [len(x.split()) for x in d]
        blocks = [(x, y) for x in range(len(d)) for y in range(x, len(d)) if sum(size[x : y + 1]) >= lines.BLOCK_WORDS]
        repeated = {p for x, y in blocks if tuple(d[x : y + 1]) in seen for p in range(x, y + 1)}
        assert set(got[i]["removed_lines"]) == repeated
        seen |= {tuple(d[x : y + 1]) for x, y in blocks}


def test_lines_in_reverse_order_go(spark):
    made = [f"one line of ten words that stands in reverse {i}" + " word" for i in range(60)]
    got = dedupe(spark, ["\n".join(made), "\n".join(["new", *made[::-1], "end"]), "\n".join(made[::3] * 2 + made[::-2])])
    assert got[2]["text"] == "new\nend" and got[3]["text"] == ""


def test_words_beyond_the_clustered_ones_get_learned_classes(spark):
    rng = random.Random(3)
    fillers = [f"f{i}" for i in range(brown.CLUSTERED)] * 5
    rng.shuffle(fillers)
    nouns, verbs = [f"no{i}" for i in range(40)], [f"verbverb{i}" for i in range(40)]
    texts = [" ".join(fillers)] + [f"da {n} ru we {v} it" for n, v in zip(nouns, verbs) for _ in range(3)]
    texts += [f"da common{i} ru we usual{i} it" for i in range(5) for _ in range(20)]
    model, _ = brown.train(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"))
    kind = {w.decode(): model.of[i] for w, i in model.head.number.items()}
    assert len(kind) > brown.CLUSTERED and all(kind[w] > brown.SHAPES for w in kind)
    assert not {kind[w] for w in nouns} & {kind[w] for w in verbs}


def test_long_labelled_texts_are_fitted_to(spark):
    """One class has texts of more than crf.FIT_LINES lines only."""
    rng = random.Random(5)
    good = ["\n".join(" ".join(rng.choice(("the", "house", "walks", "slowly", "home")) for _ in range(9)) + "." for _ in range(crf.FIT_LINES + 100)) for _ in range(8)]
    bad = ["\n".join("$$ " + "".join(rng.choices("#*%9&", k=30)) for _ in range(6)) for _ in range(8)]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "doc_id bigint, quality int")
    got = crf.score(docs, crf.fit(docs, labels), ["doc_id"]).collect()
    assert all(r["predicted"] == (r["doc_id"] < 8) for r in got)
