"""Audit of how five filters interact, by a relational pipeline of words.

1. Texts are dealt by document; their words are exploded and counted by (document, word), then by document. Both
   aggregates keep to the partitions of the texts, so words are never shuffled.
2. The other flags (capitals, symbols, copies of texts with a smaller id) come from small rows without texts and are
   joined to the word counts by an outer join.
   All joins are by a shuffle: Spark takes the size of a table's files for that of its rows, so a small file of many
   labels, each of them salted, would be broadcast whole.
3. A document's five flags are a number from 0 to 31. One aggregate with a conditional count for each number, for all,
   good and toxic documents, holds all that the 120 orders of the filters need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, middle

#: Fixed values of the filters, which stand for the bits 1, 2, 4, 8 and 16.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def word_counts(docs: DataFrame) -> DataFrame:
    """(__id, __key, n_words, n_distinct) of each document; one row for rows that agree in id and text.

    A null stands behind the words of each row: it counts the rows, by which the words of repeated rows are divided.
    """
    document = ["__id", "__key"]
    texts = middle.keyed(docs).select(*document, "__text").repartition(*document)
    words = texts.select(*document, F.explode_outer(F.concat(F.split("__text", BLANKS), F.array(F.lit(None).cast("string")))).alias("word"))
    counts = words.groupBy(*document, "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    total, rows = F.sum(F.when(real, F.col("n"))), F.sum(F.when(F.col("word").isNull(), F.col("n")))
    out = counts.groupBy(*document).agg(total.alias("total"), rows.alias("rows"), F.count_if(real).alias("n_distinct"))
    return out.select(*document, F.expr("coalesce(total, 0) div rows").alias("n_words"), "n_distinct")


def flagged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, failed): the failed filters of every row as the sum of their bits."""
    document = ["__id", "__key"]
    capitals = F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))
    c, d = 100 * capitals > MOST_CAPITALS * F.length("__text"), F.col("__text").rlike(SYMBOLS)
    rows = middle.keyed(docs, [part])
    rows = rows.select(*document, F.coalesce(F.col("__0").cast("string"), F.lit("")).alias("__part"), "__doc", c.alias("c"), d.alias("d"), F.unhex(F.sha2("__text", 256)).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last")).where("first < last").select("digest", "first")
    rows = common.salted(rows, firsts.hint("merge"), "digest", 8, "left").withColumn("e", F.coalesce(F.col("__doc") > F.col("first"), F.lit(False)))
    rows = rows.select(*document, "__part", "__doc", "c", "d", "e").join(word_counts(docs).hint("merge"), document, "left")
    n, kinds = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < LEAST_WORDS, 100 * kinds < LEAST_DISTINCT * n, F.col("c"), F.col("d"), F.col("e")]
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)]
    return rows.select(F.col("__doc").alias("doc_id"), F.col("__part").alias("part"), (bits[0] + bits[1] + bits[2] + bits[3] + bits[4]).alias("failed"))


def conditional_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 counts of the documents that failed exactly the filters of each number."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = common.salted(rows, marks.hint("merge"), "doc_id", 8, "left")
    sets = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    counts = rows.groupBy("part").agg(*[F.count_if((F.col("failed") == m) & x).alias(f"{name}_{m}") for name, x in sets.items() for m in range(32)])
    return counts.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(32)]).alias(name) for name in sets])


def total(counts: str, chosen) -> Column:
    """Sum of the counts of those numbers for which ``chosen`` holds."""
    return F.aggregate(F.transform(F.col(counts), lambda x, m: F.when(chosen(m), x).otherwise(0)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step.

    Null, empty and blank texts have no words and fail A only (and E after the first of them); a null part is the empty
    string. Rows without id are no copies and make none; of rows that agree in id and text each counts, and none of them
    is a copy of the other. A document with several label rows is good or toxic if one of them says so. An empty table
    gives an empty result; other columns of ``docs``, whatever their names, are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(f"`{part}`").alias("part"))
    counts = conditional_counts(flagged(docs, "part"), labels)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    at = F.instr  # place of a letter in the order, from 1
    bits = lambda among: sum((F.when(among(at("filter_order", x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("own", bits(lambda k: k == F.col("step"))).withColumn("earlier", bits(lambda k: k < F.col("step")))
    own, earlier = F.col("own"), F.col("earlier")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(earlier) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    # of the 120 orders, a filter is the first of the k that a document fails in 120 / k
    share = F.aggregate(F.transform(F.col("n"), lambda x, m: F.when(fails(m), F.expr("120") * x / F.bit_count(m)).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )
