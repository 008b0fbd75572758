"""Report writers and readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0"
FINDING = "array<struct<rule_id:string,severity:string,location:struct<uri:string,start_offset:int,end_offset:int,start_line:int,start_column:int,end_line:int,end_column:int>,message:string,evidence:string>>"


def json_reports(diagnostics: DataFrame) -> DataFrame:
    """uri, json: a document's findings in order, keys sorted, nulls written."""
    place = F.struct(F.col("end_column"), F.col("end_line"), F.col("end").alias("end_offset"), F.col("start_column"), F.col("start_line"), F.col("start").alias("start_offset"), F.col("uri"))
    one = F.struct("start", "end", "rule_id", F.struct("evidence", place.alias("location"), "message", "rule_id", "severity").alias("d"))
    listed = diagnostics.groupBy("uri").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["d"]).alias("diagnostics"))
    return listed.select("uri", F.to_json(F.struct("diagnostics", F.lit(VERSION).alias("schema_version")), {"ignoreNullFields": "false"}).alias("json"))


def read_json_reports(reports: DataFrame) -> DataFrame:
    """Spans of JSON reports; a finding of another document fails the job."""
    parsed = reports.select("uri", F.from_json("json", f"diagnostics {FINDING}, schema_version string", {"mode": "FAILFAST"}).alias("r"))
    rows = parsed.select("uri", F.explode("r.diagnostics").alias("d"))
    own = F.when(F.col("d.location.uri") == F.col("uri"), F.col("uri")).otherwise(F.raise_error(F.lit("a finding of another document")))
    return rows.select(own.alias("uri"), "d.rule_id", F.col("d.location.start_offset").alias("start"), F.col("d.location.end_offset").alias("end"))


def text_lines(diagnostics: DataFrame) -> DataFrame:
    line = F.format_string("%s:%d:%d: %s [%s] %s", "uri", "start_line", "start_column", "severity", "rule_id", "message")
    return diagnostics.select("uri", "start", "end", "rule_id", line.alias("line"))


def summary(n_rules: int, n_findings: int) -> str:
    """The closing line of a text report."""
    if not n_rules:
        return "No rules are enabled."
    return "No findings." if not n_findings else f"{n_findings} finding{'s' * (n_findings != 1)}."


def canonical_lines(rows: DataFrame) -> DataFrame:
    """value: each row as JSON with its columns in alphabetical order, nulls written."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_once(rows: DataFrame, path: str) -> str:
    """Writes canonical lines where nothing is yet, with the digest of all of them in a file beside; returns the digest. It is
    that of ``inventory.digests``: sums over the lines' own digests, so no task sees all lines and their order does not count."""
    from ..operators.inventory import digests

    lines = canonical_lines(rows)
    lines.write.mode("errorifexists").text(path)
    digest = digests(lines).first()["digest"]
    rows.sparkSession.createDataFrame([(json.dumps({"sha256": digest}),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.digest")
    return digest


def telemetry(events: DataFrame, path: str) -> None:
    """Appends events without any column that holds text of documents."""
    events.select(*(c for c in events.columns if c not in ("text", "context", "evidence", "excerpt"))).write.mode("append").json(path)


def write_packet(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Writes a review packet as CSV with these fields, in this order, where nothing is yet. Texts that a spreadsheet would take for a
    formula are quoted; quotes inside are doubled, and line ends stay."""
    from ..operators.holdout import csv_safe

    shown = [csv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in fields]
    rows.select(*shown).write.mode("errorifexists").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def read_packet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A review packet read back, empty texts as such. A file whose header has other fields, or the same in another order, fails the
    job, and so does a row that does not fit."""
    schema = ", ".join(f"`{c}` string" for c in fields)
    read = spark.read.option("header", "true").option("enforceSchema", "false").option("escape", '"').option("multiLine", "true").option("mode", "FAILFAST")
    return read.schema(schema).csv(path).fillna("")
