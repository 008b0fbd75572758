"""Command line: ``python -m quillspark.cli lint PATH --enable SENT-001 --text-type procedural``.

Exit codes: 0 nothing found (or a baseline written), 1 findings, 2 wrong use or a document that could not be read. Documents
that can't be read are told on standard error; the others are linted all the same.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import baseline as known
from .operators import intake
from .operators.catalog import Context, lint, read_config
from .operators.rules import CATALOG
from .sources.documents import read_documents
from .sources.reports import json_reports, summary, text_lines


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("lint")
    run.add_argument("path")
    run.add_argument("--config")
    run.add_argument("--enable", action="append", default=[])
    run.add_argument("--disable", action="append", default=[])
    run.add_argument("--text-type", choices=["procedural", "descriptive"])
    run.add_argument("--format", choices=["text", "json"], default="text")
    run.add_argument("--baseline")
    run.add_argument("--write-baseline")
    commands.add_parser("rules")
    explain = commands.add_parser("explain")
    explain.add_argument("rule_id")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    if args.command == "rules":
        print("\n".join(f"{r.rule_id}  {r.status}  {r.title}" for r in map(CATALOG.rules.get, CATALOG.ids())))
        return 0
    if args.command == "explain":
        if args.rule_id not in CATALOG.rules:
            return 2
        r = CATALOG.rules[args.rule_id]
        print(f"{r.rule_id}: {r.title}\n{r.summary}\nkind: {r.kind}, severity: {r.severity}, status: {r.status}")
        return 0
    try:
        rules, options = read_config(Path(args.config).read_text(encoding="utf-8")) if args.config else ({}, {})
        enabled = CATALOG.selected(rules, {"enable": args.enable, "disable": args.disable})
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    if args.text_type:
        options["text_type"] = args.text_type
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    docs = read_documents(spark, args.path)
    found = lint(docs, CATALOG, enabled, Context(options), with_context=bool(args.baseline or args.write_baseline))
    errors = 0
    for row in intake.problems(docs).orderBy("uri").toLocalIterator():
        errors += 1
        print(f"{row.uri}: {row.code} ({row.chars} characters)", file=sys.stderr)
    if args.write_baseline:
        known.to_json(known.baseline_of(known.fingerprints(found, docs))).write.mode("overwrite").text(args.write_baseline)
        return intake.exit_code(0, errors)
    if args.baseline:
        base = known.from_json(spark.read.option("wholetext", "true").text(args.baseline).filter("value <> ''").withColumnRenamed("value", "json"))
        found = known.unknown(known.fingerprints(found, docs), base)
    found = found.persist()
    n = found.count()
    rows = json_reports(found).orderBy("uri").select("json") if args.format == "json" else text_lines(found).orderBy("uri", "start", "end", "rule_id").select("line")
    for row in rows.toLocalIterator():
        print(row[0])
    if args.format == "text":
        print(summary(len(enabled), n))
    found.unpersist()
    return intake.exit_code(n, errors)


if __name__ == "__main__":
    sys.exit(main())
