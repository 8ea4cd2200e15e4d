"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names in every operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import bpe, brown, crf, kneser_ney, lines, matroska, ngram_join, packing, ppm, rules
from tributary.llm.queries import vocabulary

LONG = " ".join(f"word{i % 911} and" for i in range(15_000))
UNBROKEN = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
TEXTS = ["one two three four five six seven", "one two three four five six seven", "", None, "  \n\n ", "x", LONG, "a\nb\na\nlast line of it", "ünïcødé 世界 <|endoftext|> !!", UNBROKEN]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(1, TEXTS[1], "de", None, 5), (None, "null id has words here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ["n_words", "kept", "score", "ids", "piece", "start", "length", "offset", "sequence_id", "feature", "media", "lang_pred", "predicted", "n_tokens", "removed_lines", "n_lines", "sources", "class_id", "links", "key", "rid", "word", "c", "nid", "toxic", "quality"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0), (7, 1, 0), (6, 0, 0), (None, 1, 1), (99, None, None)], "doc_id bigint, quality int, toxic int")


def runs(docs, labels):
    """Every operator over ``docs``, by name."""
    model, counts = brown.train(docs)
    return {
        "rules": rules.judged(docs, rules.fit(docs, labels), ["doc_id"]),
        "ngram": ngram_join.classes(docs),
        "bpe": bpe.digests(docs, vocabulary("byte_bpe_50k.json")),
        "packing": packing.pack(docs, vocabulary("word_bpe_49k.json")),
        "media": matroska.digests(docs),
        "lines": lines.dedupe(docs).select("doc_id", "removed_lines"),
        "ppm": ppm.identify(docs, ppm.train(docs), ["doc_id"]),
        "toxicity": kneser_ney.score(docs, kneser_ney.fit(docs, labels), ["doc_id"]),
        "brown": brown.score(docs, model, counts),
        "crf": crf.score(docs, crf.fit(docs, labels), ["doc_id"]),
    }


def test_each_row_gets_a_result(docs, labels):
    n = docs.count()
    for name, df in runs(docs, labels).items():
        got = df.collect()
        assert len(got) == n if name != "packing" else len(got) >= n, name
        assert sum(r["doc_id"] is None for r in got) == 2, name


def test_clashing_columns_change_nothing(docs, clashing, labels):
    plain, other = runs(docs, labels), runs(clashing, labels)
    for name in plain:
        assert sorted(map(repr, plain[name].collect())) == sorted(map(repr, other[name].collect())), name


def test_names_that_clash_in_case_only_give_way(docs, labels, tmp_path):
    own = ["Score", "PREDICTED", "Lang_Pred", "KEPT", "Rule", "N_Lines", "Sources", "IDs", "Media", "__made", "__row", "__bpe", "__media", "__cut", "removed", "__key"]
    odd = docs.select("*", *[F.lit("x").alias(n) for n in own])
    made = {
        "toxicity": (kneser_ney.score(odd, kneser_ney.fit(odd, labels)), ["score", "predicted"]),
        "ppm": (ppm.identify(odd, ppm.train(odd)), ["lang_pred", "score", "bits_per_byte"]),
        "crf": (crf.score(odd, crf.fit(odd, labels)), ["score", "predicted"]),
        "rules": (rules.judged(odd, rules.fit(odd, labels)), ["kept", "rule", "base_failed"]),
        "lines": (lines.dedupe(odd), ["n_lines", "removed_lines", "sources"]),
        "bpe": (bpe.encode(odd, vocabulary("byte_bpe_50k.json")), ["ids"]),
        "media": (matroska.as_media(odd), ["media"]),
    }
    for name, (df, new) in made.items():
        low = [c.lower() for c in df.columns]
        assert len(low) == len(set(low)) and set(new) <= set(low), name
        kept = [c for c in own if c in df.columns]
        assert {c.lower() for c in own if c not in kept} <= {*new, "n_lines"} and len(kept) >= len(own) - 3, name
        df.write.parquet(str(tmp_path / name))
        back = df.sparkSession.read.parquet(str(tmp_path / name))
        assert back.count() == docs.count() and back.where(" and ".join(f"`{c}` = 'x'" for c in kept)).count() == docs.count(), name
    for name, df in {"keep": ppm.keep_identified(odd, ppm.train(odd)), "good": rules.keep_good(odd, labels), "clean": lines.clean(odd), "one": ngram_join.one_of_each(odd)}.items():
        assert df.columns == odd.columns and df.where(" and ".join(f"`{c}` = 'x'" for c in own)).count() == df.count(), name
        assert name == "good" or df.count(), name  # of these texts the rules may keep none


def test_a_long_run_does_not_stay_in_caches():
    encoder = bpe.loaded(vocabulary("byte_bpe_50k.json"))
    encoder.encode(UNBROKEN)
    chunks = packing.loaded(vocabulary("word_bpe_49k.json"))
    chunks.ids([UNBROKEN + ".", "short words"])
    assert max(map(len, encoder.cache)) <= bpe.LONG_UNIT and max(map(len, chunks.cache)) <= packing.LONG_CHUNK


def test_empty_tables(docs, labels):
    for name, df in runs(docs.limit(0), labels.limit(0)).items():
        assert df.collect() == [], name
    for name, df in runs(docs, labels.limit(0)).items():
        assert df.count(), name


def test_documents_pass_through_with_their_columns(clashing, labels):
    cols = clashing.columns
    assert rules.keep_good(clashing, labels).columns == cols
    assert ppm.keep_identified(clashing, ppm.train(clashing)).columns == cols
    assert lines.clean(clashing).columns == cols
    one = ngram_join.one_of_each(clashing)
    assert one.columns == cols
    got = one.select("doc_id", "text").collect()
    assert len(got) == len({r["text"] for r in got})
    assert bpe.encode(clashing, vocabulary("byte_bpe_50k.json")).schema["ids"].dataType.simpleString() == "array<int>"


def test_pipeline_on_odd_rows(docs, labels, tmp_path, spark):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids <= set(range(len(TEXTS))) | {None} and 3 not in ids and 2 not in ids
    docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "e/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).collect() == []
