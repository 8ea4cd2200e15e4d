"""API contracts: validation, lookup, and name matching of calls against resource specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators import skew

#: What a contract may say.
BEHAVIORS = ["CLOSES_INPUT", "PRESERVES_INPUT", "CREATES_RESOURCE", "RETURNS_RESOURCE", "TRANSFERS_OWNERSHIP", "CONDITIONAL_CLOSE", "UNKNOWN"]
OWNERSHIPS = ["BORROW", "CONSUME", "TRANSFER", "RETURN", "UNKNOWN"]
SAFETY = ["GUARANTEED", "NOT_GUARANTEED", "UNKNOWN"]
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_\.]*$"


def normal(value: str, allowed: list[str]) -> Column:
    """The value in capitals if it is allowed, else the first allowed word in it, else null."""
    up = F.upper(F.trim(value))
    words = F.filter(F.split(up, r"[|/,;\s]+"), lambda x: x.isin(allowed))
    return F.when(up.isin(allowed), up).otherwise(F.get(words, 0))


def validated(raw: DataFrame, least: float = 0.85) -> DataFrame:
    """Raw contracts with normalised columns and the reason of a rejection, null for those accepted."""
    conf = F.expr("try_cast(confidence as double)")
    out = raw.withColumns({"behavior_n": normal("behavior", BEHAVIORS), "ownership_n": normal("ownership", OWNERSHIPS), "safety_n": F.coalesce(normal("exception_safety", SAFETY), F.lit("UNKNOWN")), "confidence_n": conf})
    reason = (
        F.when(F.coalesce(F.trim("function"), F.lit("")) == "", "missing function")
        .when(~F.col("function").rlike(IDENTIFIER), "bad identifier")
        .when(F.col("behavior_n").isNull(), "bad behavior")
        .when(F.col("ownership_n").isNull(), "bad ownership")
        .when(F.col("confidence_n").isNull() | ~F.col("confidence_n").between(0, 1), "bad confidence")
        .when(F.col("confidence_n") < least, "low confidence")
    )
    return out.withColumn("reason", reason)


def split_name(call: str) -> tuple[Column, Column]:
    """(library, function) of a dotted call name; a bare name is of builtins."""
    return F.coalesce(F.nullif(F.regexp_extract(call, r"^(.*)\.[^.]+$", 1), F.lit("")), F.lit("builtins")), F.element_at(F.split(call, r"\."), -1)


def resolved(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """Calls (call_name) with the behavior of their contract, UNKNOWN where there is none; of equal keys the first counts."""
    lib, fun = split_name("call_name")
    w = Window.partitionBy("library", "function").orderBy("pos")
    one = contracts.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("library", "function", "behavior")
    return calls.withColumn("library", lib).withColumn("function", fun).join(one, ["library", "function"], "left").withColumn("behavior", F.coalesce("behavior", F.lit("UNKNOWN")))


def canonical(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (unit, call_name) with the head segment replaced through the imports (unit, local, canonical)."""
    head = F.get(F.split("call_name", r"\."), 0)
    i = imports.select("unit", F.col("local").alias("__head"), "canonical")
    c = calls.withColumn("__head", head).join(i, ["unit", "__head"], "left")
    return c.withColumn("resolved", F.when(F.col("canonical").isNull(), F.col("call_name")).otherwise(F.concat("canonical", F.expr("substring(call_name, length(__head) + 1)")))).drop("__head", "canonical")


def suffixes(name: str) -> Column:
    """The dotted suffixes of a name, the whole name first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def hits(calls: DataFrame, specs: DataFrame, name: str, *totals: Column) -> DataFrame:
    """(name, totals) of each different name of ``calls`` over all specs that it matches: equal names, or one a dotted
    suffix of the other.

    Either a spec is a suffix of the name (the name is one, too), or the name is a shorter suffix of the spec. So both
    sides give keys marked with the kind of match that they are for, and equal keys are a match, each pair once: a common
    last segment is a key only where it is the whole name on one side. Specs are summed up by key before they meet names.
    """
    names = calls.select(name).distinct()
    whole, part = F.lit("spec is whole"), F.lit("name is whole")
    mark = lambda keys, kind: F.transform(keys, lambda k: F.struct(k.alias("key"), kind.alias("kind")))
    own = suffixes("acquire")
    dealt = specs.select("*", F.explode(F.concat(mark(F.slice(own, 1, 1), whole), mark(F.slice(own, 2, F.size(own)), part))).alias("k"))
    asked = names.select(name, F.explode(F.concat(mark(suffixes(name), whole), mark(F.array(name), part))).alias("k"))
    dealt = dealt.select(*specs.columns, "k.key", "k.kind").groupBy("key", "kind").agg(F.collect_list(F.struct(*specs.columns)).alias("specs"))
    met = skew.salted(asked.select(name, "k.key", "k.kind"), dealt, ["key", "kind"], "inner")
    return met.select(name, F.explode("specs").alias("s")).select(name, "s.*").groupBy(name).agg(*totals)


def matched(calls: DataFrame, specs: DataFrame, name: str = "resolved") -> DataFrame:
    """Calls with the first spec (acquire, release, pos) that they match; calls without one go."""
    best = hits(calls, specs, name, F.min_by(F.struct("acquire", "release"), "pos").alias("m"))
    return skew.salted(calls, best, [name], "inner").select(*calls.columns, "m.acquire", "m.release")


def match_counts(calls: DataFrame, specs: DataFrame, name: str = "resolved") -> DataFrame:
    """Calls with the number of specs that they match; calls without one go."""
    return skew.salted(calls, hits(calls, specs, name, F.count("*").alias("specs")), [name], "inner")
