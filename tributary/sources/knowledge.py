"""Knowledge bases and configurations as tables: resource rules, contracts and specs of landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import specs

RULES = "kind string, name string, release string, others array<string>, behavior string, ownership string, exception_safety string"
RESOURCES = "resources array<struct<acquire:string,release:string,alt_releases:array<string>>>, exception_safety boolean"


def entries(text: str | None) -> list[tuple]:
    """Rules and contracts of one YAML document; a text that is no mapping has none."""
    rules = [("rule", r.acquire, r.releases[0], [*r.releases[1:]], None, None, None) for r in specs.load_rules(text or "")]
    return rules + [("contract", ".".join(k), None, None, c.behavior, c.ownership, c.exception_safety) for k, c in specs.load_contracts(text or "").items()]


def rules(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, ...) of the rules and contracts in YAML documents; documents without any have no row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [(k, *e) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in entries(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in made], schema=schema)

    names = [f.split()[0] for f in RULES.split(", ")]
    kinds = [pa.list_(pa.string()) if n == "others" else pa.string() for n in names]
    schema = pa.schema([("__key", pa.int64()), *zip(names, kinds)])
    return documents.select(F.col(key).cast("bigint").alias("__key"), text).mapInArrow(run, f"__key bigint, {RULES}").withColumnRenamed("__key", key)


def first_contracts(found: DataFrame, *order: str) -> DataFrame:
    """The first contract of each name over all documents."""
    rows = found.where("kind = 'contract'")
    return rows.groupBy("name").agg(F.min_by(F.struct("behavior", "ownership", "exception_safety"), F.struct(*order)).alias("c")).select("name", "c.*")


def configured(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, acquire, release, others, exception_safety): specs of JSON configurations in their order.

    An empty or absent list of resources, and a text that is no JSON object, stand for the default specs; a release that
    is not given is close.
    """
    default = F.array(*[F.struct(F.lit(s.acquire).alias("acquire"), F.lit(s.release).alias("release"), F.array(*[F.lit(x) for x in s.others]).cast("array<string>").alias("alt_releases")) for s in specs.Config().specs])
    made = documents.select(key, F.from_json(text, RESOURCES).alias("c"))
    own = F.when(F.coalesce(F.size("c.resources"), F.lit(0)) > 0, F.col("c.resources")).otherwise(default)
    rows = made.select(key, F.coalesce("c.exception_safety", F.lit(True)).alias("exception_safety"), F.posexplode(own).alias("pos", "s"))
    return rows.select(key, "pos", "s.acquire", F.coalesce("s.release", F.lit("close")).alias("release"), F.coalesce("s.alt_releases", F.array().cast("array<string>")).alias("others"), "exception_safety")
