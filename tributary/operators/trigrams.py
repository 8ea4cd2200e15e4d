"""Substring search through an index of trigrams.

The index is written once: rows with their searched texts in lower case, in parts of about PART_ROWS rows, and postings
(field, gram, part, docs), sorted by gram so that a search reads only the row groups of its grams. A search intersects the
postings of its needles' grams by counting, reads the parts that still hold candidates, and tests the texts of these.
Needles of fewer than three characters have no gram; what they ask for is tested on the candidates of the others, or on
all rows where there are no others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.rounds import cut, folder

#: Rows of one part, and so the most of one posting; parts up to which a search names those that it reads.
PART_ROWS, NAMED_PARTS = 16_384, 2_000


def grams(text: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    n = F.greatest(F.length(text) - 2, F.lit(0))
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(3))))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    place: str
    key: str
    fields: tuple[str, ...]
    parts: int

    @property
    def rows(self) -> DataFrame:
        """The indexed rows with their lower-case texts and parts."""
        return self.spark.read.parquet(f"{self.place}/rows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/postings")

    def candidates(self, clauses: list[list[tuple[str, str]]]) -> DataFrame | None:
        """(part, doc) of the rows that have all grams of a needle of each clause; None where no clause has grams alone."""
        asked = []
        for i, clause in enumerate(clauses):
            needles = [(f, sorted({n[k : k + 3] for k in range(len(n) - 2)})) for f, n in clause]
            if all(g for _, g in needles):
                asked += [(i, j, f, g, len(gs)) for j, (f, gs) in enumerate(needles) for g in gs]
        if not asked:
            return None
        wanted = self.spark.createDataFrame(asked, "clause int, needle int, field string, gram string, of int")
        found = self.postings.where(F.col("gram").isin(sorted({a[3] for a in asked})))
        docs = found.join(F.broadcast(wanted), ["field", "gram"]).select("clause", "needle", "of", "part", F.explode("docs").alias("doc"))
        whole = docs.groupBy("part", "doc", "clause", "needle", "of").agg(F.count("*").alias("n")).where("n = of")
        return whole.groupBy("part", "doc").agg(F.count_distinct("clause").alias("n")).where(F.col("n") == len({a[0] for a in asked})).select("part", "doc")

    def search(self, clauses: list[list[tuple[str, str]]]) -> DataFrame:
        """Rows that hold, for each clause, one of its (field, needle) pairs, whatever the case; an empty clause holds nowhere."""
        clauses = [[(f, n.lower()) for f, n in clause] for clause in clauses]
        test = reduce(Column.__and__, [reduce(Column.__or__, [F.contains(F.col(lowered(f)), F.lit(n)) for f, n in c], F.lit(False)) for c in clauses], F.lit(True))
        rows, found = self.rows, self.candidates(clauses)
        if found is not None:
            found = cut(found)
            hit = found.select("part").distinct().limit(NAMED_PARTS + 1).collect()
            if len(hit) <= NAMED_PARTS:  # a filter on folders; beyond that the join alone
                rows = rows.where(F.col("part").isin([r["part"] for r in hit]))
            rows = rows.join(found.withColumnRenamed("doc", self.key), ["part", self.key], "left_semi")
        return rows.where(test).drop("part", *[lowered(f) for f in self.fields])


def lowered(field: str) -> str:
    return f"__lower_{field}"


def build(rows: DataFrame, key: str, fields: dict[str, Column], place: str | None = None) -> Index:
    """Writes the index of ``rows``, whose ``key`` is a distinct number, over ``fields``; a null text is empty.

    Without ``place`` it goes to the shared checkpoint folder. An index can be searched any number of times.
    """
    spark = rows.sparkSession
    place = place or f"{folder(spark)}/trigrams-{uuid.uuid4().hex}"
    parts = max(1, -(-rows.count() // PART_ROWS))
    texts = {lowered(f): F.lower(F.coalesce(c, F.lit(""))) for f, c in fields.items()}
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    rows.withColumns(texts).withColumn("part", part).repartition(parts, "part").write.partitionBy("part").parquet(f"{place}/rows")
    index = Index(spark, place, key, tuple(fields), parts)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), grams(F.col(lowered(f))).alias("grams")) for f in fields]))
    found = index.rows.select("part", F.col(key).alias("doc"), each.alias("e")).select("part", "doc", "e.field", F.explode("e.grams").alias("gram"))
    lists = found.groupBy("field", "gram", "part").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    lists.repartitionByRange("gram", "field", "part").sortWithinPartitions("gram", "field", "part").write.parquet(f"{place}/postings")
    return index
