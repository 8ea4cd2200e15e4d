"""A training corpus from documents: language, quality, repeated lines, near duplicates, packed sequences.

Each stage takes (spark, docs, sf_dir) and gets all rows that the stage before it kept, written as Parquet in the
shared checkpoint folder and read again; a stage's rows are removed once the next stage has written its own. All stages
but the last return the columns of ``documents``, other columns included, whatever their names. Texts of any length are
taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import common, lines, ngram_join, packing, ppm, rules
from tributary.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined: null, empty and letterless texts go, and those for which no language
    has a posterior of 0.5. Repeated rows agree; null ids are kept like others."""
    return ppm.keep_identified(docs, ppm.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the base rule and the learned decision list accept; null and empty texts fail the base rule.

    Rows are judged one by one. Of several labels of a document the worse counts; without labels only the base rule holds.
    """
    return rules.keep_good(docs, common.read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; a document of which nothing remains goes.

    Earlier is a smaller doc_id, then a smaller hash of the text. Rows without id and null or empty texts stay as they are;
    rows that agree in id and text are cut alike.
    """
    return lines.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of similar ones, by doc_id (null before all others), then by text hash; of
    rows that agree in both, and of all null, empty and blank texts, one stays."""
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences; a null or empty text is its end mark alone, and
    repeated rows are packed as often as they are there."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language), ("quality_rules", quality), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("best_fit_packing", pack)]

#: The first stages are learned models, which SQL does not express; tests/llm/test_pipeline.py holds every stage against a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder, before = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
