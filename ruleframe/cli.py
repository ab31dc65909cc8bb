"""Command line: ``python -m ruleframe.cli analyze --rules R --input DIR --output FILE`` and ``... deps --listing FILE --output FILE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ruleframe import sinks
from ruleframe.functions.labels import label_selector
from ruleframe.operators import dependencies as D
from ruleframe.operators import emit
from ruleframe.plans.engine import Analyzer
from ruleframe.plans.rules import load
from ruleframe.sources import dependencies as SD
from ruleframe.sources import files as S
from ruleframe.sources.symbols import symbols


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ruleframe")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="evaluate rules over a source tree")
    a.add_argument("--rules", action="append", required=True)
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True, help="a YAML report")
    a.add_argument("--tables", help="a folder for the result as tables")
    a.add_argument("--label-selector", action="append", default=[])
    a.add_argument("--incident-selector")
    a.add_argument("--limit-incidents", type=int, default=emit.MOST_INCIDENTS)
    a.add_argument("--limit-code-snips", type=int, default=emit.MOST_SNIPPETS)
    a.add_argument("--context-lines", type=int, default=emit.CONTEXT)
    a.add_argument("--charset", default="UTF-8")
    a.add_argument("--exclude-dir", action="append")
    a.add_argument("--error-on-violation", action="store_true")
    d = commands.add_parser("deps", help="dependencies of a Maven or Gradle listing")
    d.add_argument("--listing", required=True)
    d.add_argument("--tool", choices=["maven", "gradle"], default="maven")
    d.add_argument("--output", required=True)
    d.add_argument("--open-source", action="append", default=[], help="a regex of open-source names")
    d.add_argument("--label-selector")
    d.add_argument("--tree", action="store_true")
    return top


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    files = S.read_tree(spark, args.input, args.charset, args.exclude_dir)
    rules = [r for path in args.rules for r in load(path)]
    analyzer = Analyzer(files=files, symbols=symbols(files), deps=SD.pom_rows(files))
    result = analyzer.run(rules, args.label_selector, args.incident_selector, args.limit_incidents, snippets=args.limit_code_snips, context=args.context_lines)
    sinks.write_report(result, args.output)
    if args.tables:
        sinks.write_tables(result, args.tables)
    return sinks.exit_code(result, args.error_on_violation)


def list_dependencies(spark: SparkSession, args: argparse.Namespace) -> int:
    text = S.lines(spark.read.text(args.listing, wholetext=True).select(F.lit(args.listing).alias("path"), F.col("value").alias("content")))
    tree = SD.maven_listing(text) if args.tool == "maven" else SD.gradle_listing(text)
    rows = tree.select(F.col("path").alias("file_uri"), "name", "version", (F.col("type") if args.tool == "maven" else F.lit("")).alias("type"), (F.col("depth") > 0).alias("indirect"), F.lit("").alias("resolved_id"))
    rows = D.labelled(D.distinct_dependencies(rows).withColumn("type", F.lit("")), {p: "open-source" for p in args.open_source})
    if args.label_selector:
        rows = rows.filter(label_selector(F.col("labels"), args.label_selector))
    edges = tree.filter("parent is not null").select(F.col("path").alias("file_uri"), "parent", F.col("name").alias("child")) if args.tree else None
    sinks.write_dependencies(rows, args.output, edges)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ruleframe").getOrCreate()
    return analyze(spark, args) if args.command == "analyze" else list_dependencies(spark, args)


if __name__ == "__main__":
    sys.exit(main())
