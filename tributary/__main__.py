"""Command line: ``python -m tributary scan|fix|benchmark targets...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tributary.functions import corpus, specs
from tributary.operators import engine, rollups
from tributary.sources import files


def configured(args: argparse.Namespace) -> specs.Config:
    """The configuration of a JSON file, with the rules and contracts of a YAML file."""
    read = lambda path: open(path, encoding="utf-8").read() if path else ""
    return specs.with_knowledge(specs.from_json(read(args.config)), read(args.knowledge))


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prints a report line for each finding, or a JSON array for each file; 1 if a finding is definite."""
    u = files.collect(spark, args.targets).select(F.xxhash64("path").alias("unit_id"), "path", "source")
    found = engine.findings(u, configured(args))
    for r in found.where("parse_error is not null").select("path", "parse_error").orderBy("path").toLocalIterator():
        print(f"{r['path']}: {r['parse_error']}", file=sys.stderr)
    found = found.where("parse_error is null")
    rows = engine.json_report(found).select(F.col("document").alias("line")) if args.json else engine.text_report(found).select(F.col("report").alias("line"))
    for r in rows.orderBy("line").toLocalIterator():
        print(r["line"])
    return int(not found.where("confidence = 'definite'").isEmpty())


def fix(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prints each file that a fix changes, as it would be."""
    u = files.collect(spark, args.targets).select(F.xxhash64("path").alias("unit_id"), "path", "source")
    for r in engine.fixed(u, configured(args)).where(F.size("applied") > 0).orderBy("path").toLocalIterator():
        print(f"# {r['path']}: {', '.join(r['applied'])}\n{r['fixed_source']}")
    return 0


def benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prints precision, recall, F1 and accuracy on the labelled sources."""
    cases = [(i, t[0], t[1], corpus.source(i, 0)) for i, t in enumerate(corpus.TEMPLATES[: corpus.LABELLED])]
    u = spark.createDataFrame(cases, "unit_id bigint, path string, expected string, source string")
    print(rollups.confusion(engine.verdicts(u.select("unit_id", "expected", "source"), configured(args))).first().asDict())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tributary")
    parser.add_argument("verb", choices=["scan", "fix", "benchmark"])
    parser.add_argument("targets", nargs="*", help="files, directories or globs")
    parser.add_argument("--config", help="JSON file of resource specs")
    parser.add_argument("--knowledge", help="YAML file of rules and contracts")
    parser.add_argument("--json", action="store_true", help="JSON instead of text")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tributary").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return {"scan": scan, "fix": fix, "benchmark": benchmark}[args.verb](spark, args)


if __name__ == "__main__":
    sys.exit(main())
