"""Every stage of the pipeline against a plain version of its decisions, on whole small tables."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_methods import plain_first_fit_decreasing, plain_links, plain_stats
from tributary.llm import common, lines, packing, ppm, rules
from tributary.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage, by name."""
    docs, out = common.read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF).persist()
        out[name] = before, docs.toPandas()
    return out


def plain_code_lengths(train, texts):
    """Bits of each text under context trees of one language, counted with dictionaries."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        s = ppm.START + t
        for i in range(3, len(s)):
            for k in range(4):
                seen[s[i - k : i]][s[i]] += 1
    total = {c: (sum(n.values()), len(n)) for c, n in seen.items()}

    def bits(s, i):
        out = 0.0
        for k in (3, 2, 1, 0):
            if (c := s[i - k : i]) in total:
                n, d = total[c]
                if s[i] in seen[c]:
                    return out - math.log2(seen[c][s[i]] / (n + d))
                out -= math.log2(d / (n + d))
        return out + 8

    return [sum(bits(ppm.START + t, i) for i in range(3, len(t) + 3)) for t in texts]


def test_language(stages):
    before, after = stages["language_id"]
    texts = [(t or "").encode() for t in before.text]
    assert before.groupby("lang").size().max() <= ppm.TEXTS  # so that all texts are learned from
    table = np.array([plain_code_lengths([t for t, x in zip(texts, before.lang) if x == lang and t], texts) for lang in sorted(set(before.lang.dropna()))]).T
    posterior = 1 / np.exp2(np.clip(table.min(axis=1, keepdims=True) - table, -1000, 0)).sum(axis=1)
    keep = [bool(ppm.LETTER.search(t.decode())) and p >= 0.5 for t, p in zip(texts, posterior)]
    assert sorted(after.doc_id) == sorted(before.doc_id[keep]) and list(after.columns) == list(before.columns)


def test_quality(stages, spark):
    before, after = stages["quality_rules"]
    docs = spark.createDataFrame(before[["doc_id", "text"]])
    learned = rules.fit(docs, common.read(spark, SF, "labels"))
    got = rules.statistics(docs, keep=["doc_id"]).select("*", *[F.expr(e).alias(f"x_{c}") for c, e in rules.FEATURES.items()]).toPandas()
    x = {c: got[f"x_{c}"].to_numpy(float) for c in rules.FEATURES}
    hit = np.zeros(len(got), bool)
    for rule in learned.rules:
        hit |= rules.covered(rule, x, len(got))
    text = dict(zip(before.doc_id, before.text))
    keep = set()
    for doc, bad in zip(got.doc_id, hit):
        n, *_, repeated = plain_stats(text[doc])
        if not bad and n >= 10 and 100 * repeated <= 20 * n:
            keep.add(doc)
    assert set(after.doc_id) == keep and len(after) == len(keep)


def test_lines(stages):
    before, after = stages["line_dedup"]
    old, new = dict(zip(before.doc_id, before.text)), dict(zip(after.doc_id, after.text))
    seen = set()
    for doc in sorted(old):
        solid = [x for x in old[doc].encode().split(b"\n") if x.strip(lines.SPACE)]
        size = [len(x.split()) for x in solid]
        windows = {(x, y): b"\n".join(solid[x : y + 1]) for x, y in lines.windows(size, lines.BLOCK_WORDS)}
        repeated = {p for (x, y), h in windows.items() if h in seen for p in range(x, y + 1)}
        left = [x for x in new.get(doc, "").encode().split(b"\n") if x.strip(lines.SPACE)]
        # what is left is the text less repeated lines, and what is repeated but left is short and stands crossed
        i, gone = 0, set()
        for p, x in enumerate(solid):
            if i < len(left) and left[i] == x:
                i += 1
            else:
                gone.add(p)
        assert i == len(left) and gone <= repeated
        stays = repeated - gone
        for p in stays:
            a = b = p
            while a - 1 in repeated:
                a -= 1
            while b + 1 in repeated:
                b += 1
            assert sum(size[a : b + 1]) < lines.CROSSED_WORDS
        seen |= set(windows.values())
    assert (after.n_chars == [len(t) for t in after.text]).all()


def test_near_duplicates(stages):
    before, after = stages["ngram_jaccard"]
    before = before.sort_values("doc_id").reset_index(drop=True)
    _, roots = plain_links(before.text.tolist())
    assert sorted(after.doc_id) == sorted(before.doc_id[sorted(set(roots))])


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    sizes = []
    for doc, text in zip(before.doc_id, before.text):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        mine = after[after.doc_id == doc].sort_values("piece")
        cut = [ids[i : i + packing.CAPACITY] for i in range(0, len(ids), packing.CAPACITY)]
        assert mine.length.tolist() == [*map(len, cut)] and mine.start.tolist() == [i * packing.CAPACITY for i in range(len(cut))]
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
        sizes += map(len, cut)
    for _, bin in after.groupby("sequence_id"):
        bin = bin.sort_values("offset")
        assert bin.offset.tolist() == [0, *np.cumsum(bin.length)[:-1]] and bin.length.sum() <= packing.CAPACITY
    assert after.sequence_id.nunique() <= plain_first_fit_decreasing(collections.Counter(sizes), packing.CAPACITY)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    want = stages["best_fit_packing"][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, want[key].to_numpy()))
