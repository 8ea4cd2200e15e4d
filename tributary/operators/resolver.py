"""Contracts of unknown functions from providers that are asked in order.

Only what no contract is known of is asked for, each different function once a provider; an answer counts if it passes the
validation of contracts, else the next provider is asked. What is found is kept by an upsert, so a later run does not ask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import contracts
from tributary.operators.rounds import cut

KEY = ["library", "function"]
ANSWER = "library string, function string, behavior string, ownership string, exception_safety string, confidence string"
FIELDS = ["behavior", "ownership", "exception_safety", "confidence"]

#: Keys that one task of a provider asks for; a provider's answers are slow, so tasks are small.
KEYS_A_TASK = 256

Provider = Callable[[DataFrame], DataFrame]


def unknown(calls: DataFrame, known: DataFrame, name: str = "call_name") -> DataFrame:
    """The different (library, function) of calls that have no contract."""
    library, function = contracts.split_name(name)
    return calls.select(library.alias("library"), function.alias("function")).where("function <> ''").distinct().join(known.select(*KEY), KEY, "left_anti")


def by_call(ask: Callable[[str, str], dict | None]) -> Provider:
    """A provider that asks for one function at a time, within tasks; None stands for no answer, and so does an error."""

    def provide(keys: DataFrame) -> DataFrame:
        import pyarrow as pa

        names = [f.split()[0] for f in ANSWER.split(", ")]

        def run(batches):
            for batch in batches:
                rows = []
                for library, function in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        got = ask(library, function)
                    except Exception:  # a provider that fails is like one that does not know
                        got = None
                    if got is not None:
                        rows.append({"library": library, "function": function} | {f: None if got.get(f) is None else str(got[f]) for f in FIELDS})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in names]))

        dealt = keys.select(*KEY).repartition(max(1, -(-keys.count() // KEYS_A_TASK)), *KEY)
        return dealt.mapInArrow(run, ANSWER)

    return provide


def answered(keys: DataFrame, providers: dict[str, Provider], least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(contracts found, with their provider; answers that were rejected, with provider and reason) for different keys.

    Of several answers of one provider for a function the first by behavior, ownership and safety counts; a function that
    no provider knows has no row in the first table.
    """
    left, found, rejected = cut(keys.select(*KEY).distinct()), [], []
    for name, provide in providers.items():
        # the keys on the left, so that an answer for what was not asked is dropped
        raw = left.join(provide(left), KEY)
        checked = cut(contracts.validated(raw, least).withColumn("provider", F.lit(name)))
        good = checked.where("reason is null").groupBy(*KEY, "provider").agg(F.min(F.struct(F.col("behavior_n").alias("behavior"), F.col("ownership_n").alias("ownership"), F.col("safety_n").alias("exception_safety"), F.col("confidence_n").alias("confidence"))).alias("c"))
        found.append(good.select(*KEY, "provider", "c.*"))
        rejected.append(checked.where("reason is not null").select(*KEY, "provider", "reason"))
        left = cut(left.join(good, KEY, "left_anti"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(found), union(rejected)


def kept(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known contracts (library, function, provider, ...) with those found; what was known stays."""
    new = found.join(known.select(*KEY), KEY, "left_anti")
    return known.unionByName(new)
