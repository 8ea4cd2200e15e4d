"""The analyzer as table functions over source units.

A unit is (unit_id, path, source). Each distinct source is parsed and analyzed once, however many units share it: units
are reduced to distinct hashes before the Python stage and its rows are joined back by hash.
"""

from __future__ import annotations

import ast
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import flow as cf
from tributary.functions import export, liveness, rewrite
from tributary.functions.specs import Config

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FINDING = (
    "func string, var string, line int, col int, acquire string, acquire_line int, release string, kind string, confidence string, severity string, "
    "fixability string, resource_type string, reasons array<string>, message string, cleanup_line int, exception_note string, "
    "leaking_paths array<array<int>>, safe_paths array<array<int>>, truncated boolean"
)


def table_function(units: DataFrame, schema: str, rows_of: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """Rows of ``schema`` for each unit; a source that does not parse has the row (parse_error) alone."""
    spark = units.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    out_type = StructType.fromDDL("sha string, parse_error string, " + schema)
    arrow = [to_arrow_type(f.dataType) for f in out_type.fields]
    names = [f.name for f in out_type.fields]
    width = len(fields.fields)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for sha, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = [(sha, None, *r) for r in rows_of(source or "", sha)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    got = [(sha, f"{type(e).__name__}: {e}"[:200], *[None] * width)]
                for r in got:
                    for c, x in zip(cols, r):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow)], names=names)

    keyed = units.withColumn("sha", F.sha2(F.coalesce("source", F.lit("")), 256))
    made = keyed.select("sha", "source").dropDuplicates(["sha"]).mapInArrow(run, out_type)
    return keyed.drop("source").join(made, "sha").drop("sha")


def findings(units: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per finding."""

    def rows(source: str, _: str):
        for f in liveness.analyze(source, config=config):
            yield tuple(f[n.split()[0]] for n in COLUMNS)

    return table_function(units, FINDING, rows)


COLUMNS = [c.strip() for c in FINDING.replace("array<array<int>>", "a").replace("array<string>", "a").split(",")]


def verdicts(units: DataFrame, config: Config | None = None) -> DataFrame:
    """leak, potential, safe or error for each unit."""

    def rows(source: str, _: str):
        found = liveness.analyze(source, config=config)
        yield liveness.verdict(found), len(found)

    got = table_function(units, "verdict string, n_findings int", rows)
    return got.withColumn("verdict", F.coalesce("verdict", F.lit("error"))).withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def imports(units: DataFrame) -> DataFrame:
    return table_function(units, "local string, canonical string", lambda s, _: iter(cf.import_map(ast.parse(s)).items()))


def acquires(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Assignments of acquiring calls, names resolved through the imports."""

    def rows(source: str, _: str):
        unit = liveness.Unit(source, config or Config())
        for n in ast.walk(unit.tree):
            var, value = liveness.target_of(n) if isinstance(n, ast.stmt) else (None, None)
            if var and isinstance(value, ast.Call) and (spec := unit.acquires(unit.name(value))):
                yield var, n.lineno, unit.name(value), spec.acquire, n.lineno in unit.in_loop, n.lineno in unit.in_try

    return table_function(units, "var string, line int, call string, acquire string, in_loop boolean, in_try boolean", rows)


def blocks(units: DataFrame) -> DataFrame:
    """Control flow blocks of every function with their exits."""

    def rows(source: str, _: str):
        for d in cf.functions(ast.parse(source)):
            for i, b in enumerate(cf.Flow(d.body).blocks):
                guards = [g for _, g in b.exits]
                yield d.name, i, len(b.items), i == 0, [t for t, _ in b.exits], guards, cf.exit_labels(guards)

    return table_function(units, "func string, block int, n_stmts int, is_entry boolean, exits array<int>, guards array<string>, labels array<string>", rows)


def tagged_blocks(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Blocks of every function with leak, safe or no tag, from one analysis of each source."""

    def rows(source: str, _: str):
        found = liveness.analyze(source, config=config)
        for d in cf.functions(ast.parse(source)):
            leak, safe = export.tags(found, d.name)
            for i, b in enumerate(cf.Flow(d.body).blocks):
                yield d.name, i, len(b.items), i == 0, not b.exits, "leak" if i in leak else "safe" if i in safe else None

    return table_function(units, "func string, block int, n_stmts int, is_entry boolean, is_exit boolean, tag string", rows)


def events(units: DataFrame, config: Config | None = None) -> DataFrame:
    """What the walks meet (alias, release, finally, return, managed), with the verdict on the unit."""

    def rows(source: str, _: str):
        verdict = liveness.verdict(liveness.analyze(source, config=config))
        for func, _, walk in liveness.walks(liveness.Unit(source, config or Config())):
            for kind, line, var, detail in sorted(walk.events):
                yield func, kind, line, var, detail, verdict

    return table_function(units, "func string, kind string, line int, var string, detail string, verdict string", rows)


def documents(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Each unit as one JSON document with all that is known about it, from one pass over each distinct source.

    The document names no path, since units of equal sources share it; the unit's path stands beside it.
    """
    return table_function(units, "document string", lambda s, _: iter([(json.dumps(export.document(s, config=config)),)]))


def displayed(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Acquisitions as they are shown: once for each variable and line."""
    return table_function(units, "var string, acquire string, release string, line int", lambda s, _: (tuple(r.values()) for r in export.acquisitions(liveness.Unit(s, config or Config()))))


def nodes(units: DataFrame) -> DataFrame:
    return table_function(units, "node int, parent int, depth int, type string, line int", lambda s, _: iter(cf.ast_rows(ast.parse(s))))


def complexity(units: DataFrame) -> DataFrame:
    return table_function(units, "loc int, depth int, branches int, loops int, functions int", lambda s, _: iter([tuple(cf.complexity(ast.parse(s), s).values())]))


def effects(units: DataFrame, config: Config | None = None) -> DataFrame:
    """What each function of a file does to its parameters."""

    def rows(source: str, _: str):
        unit = liveness.Unit(source, config or Config())
        for d in unit.defs:
            for i, a in enumerate([*d.args.posonlyargs, *d.args.args]):
                yield d.name, i, a.arg, unit.effect(d.name, i)

    return table_function(units, "func string, pos int, param string, effect string", rows)


def fixed(units: DataFrame, config: Config | None = None) -> DataFrame:
    def rows(source: str, _: str):
        new, applied, rejected = rewrite.fix(source, config)
        yield new, applied, rejected

    return table_function(units, "fixed_source string, applied array<string>, rejected array<string>", rows)


def scouted(units: DataFrame, config: Config | None = None) -> DataFrame:
    return table_function(units, "line int, var string, rule string", lambda s, _: iter(rewrite.scout(s, config)))


def ensemble(units: DataFrame, config: Config | None = None) -> DataFrame:
    """Scouted lines with the analyzer's verdict on them, from one pass over each distinct source."""

    def rows(source: str, _: str):
        acquired = export.acquisitions(liveness.Unit(source, config or Config()))
        for x in export.opinions(rewrite.scout(source, config), liveness.analyze(source, config=config), acquired):
            yield tuple(x.values())

    return table_function(units, "line int, var string, rule string, verdict string", rows).where("parse_error is null").drop("parse_error")


def text_report(found: DataFrame) -> DataFrame:
    """A line for each finding with its first leaking path."""
    path = F.concat_ws(" -> ", F.transform(F.slice(F.get("leaking_paths", 0), 1, 5), lambda b: F.concat(F.lit("B"), b.cast("string"))))
    title = F.when(F.col("confidence") == "definite", "LEAK").otherwise("POSSIBLE LEAK")
    return found.select("unit_id", F.concat(title, F.lit(" "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "message", F.lit(" ["), F.coalesce(path, F.lit("")), F.lit("]")).alias("report"))


#: The fields of a finding's record.
RECORD = "rule severity confidence resource_type file func line col var acquire release message acquire_line kind leaking_paths safe_paths exception_note cleanup_line fixability leak_reasons".split()


def json_report(found: DataFrame) -> DataFrame:
    """The findings of each unit as one JSON array of records of twenty fields, in order of their lines."""
    own = {"rule": F.lit(export.RULE), "file": F.col("path"), "cleanup_line": F.nullif("cleanup_line", F.lit(0)), "leak_reasons": F.col("reasons")}
    row = F.struct(*[own.get(n, F.col(n)).alias(n) for n in RECORD])
    g = found.where("parse_error is null").groupBy("unit_id", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("acquire_line", "func", "var", row.alias("row")))), lambda x: x["row"]).alias("leaks"))
    return g.select("unit_id", F.to_json("leaks", {"ignoreNullFields": "false"}).alias("document"))


def register(spark: SparkSession, name: str, config: Config | None = None) -> None:
    """``name``(source) as a table function of SQL: the findings of a source, or one row with what is wrong with it."""
    from pyspark.sql.functions import udtf

    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)

    class Findings:
        def eval(self, source: str):
            try:
                for f in liveness.analyze(source or "", config=config):
                    yield (*(f[n.split()[0]] for n in COLUMNS), None)
            except (SyntaxError, ValueError, RecursionError) as e:
                yield (*[None] * len(COLUMNS), f"{type(e).__name__}: {e}"[:200])

    spark.udtf.register(name, udtf(Findings, returnType=FINDING + ", parse_error string"))


def from_texts(spark: SparkSession, sources: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(sources, "unit_id bigint, path string, source string")
