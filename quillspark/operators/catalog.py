"""The rule catalog, rule selection, and the engine that runs enabled rules over documents."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")
KINDS = ("deterministic", "nlp", "semantic", "human-review")
STATUSES = ("planned", "preview", "stable")
RULE_ID = re.compile(r"[A-Z]{4}-\d{3}")
DIAGNOSTIC = ("rule_id", "severity", "uri", "start", "end", "start_line", "start_column", "end_line", "end_column", "message", "evidence")


@dataclass(frozen=True)
class Context:
    """What rules may need besides documents: options, and named side tables such as parses."""

    options: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """A rule: metadata, and a function from documents (uri, text) to spans (uri, start, end, evidence)."""

    rule_id: str
    title: str
    summary: str
    message: str
    find: Callable[[DataFrame, Context], DataFrame]
    kind: str = "deterministic"
    severity: str = "info"
    status: str = "preview"

    def __post_init__(self):
        if not RULE_ID.fullmatch(self.rule_id) or self.kind not in KINDS or self.severity not in SEVERITIES or self.status not in STATUSES:
            raise ValueError(f"not a valid rule: {self.rule_id}")
        if not (self.title and self.summary and self.message):
            raise ValueError(f"{self.rule_id} lacks texts")
        if (self.kind == "semantic" or self.status == "preview") and self.severity != "info":
            raise ValueError(f"{self.rule_id}: preview and semantic rules report info at most")


class Catalog:
    """Rules by id; ids are unique and listed in order."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules: dict[str, Rule] = {}
        for rule in rules:
            if rule.rule_id in self.rules:
                raise ValueError(f"{rule.rule_id} is there twice")
            self.rules[rule.rule_id] = rule

    def ids(self) -> list[str]:
        return sorted(self.rules)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.title, r.kind, r.severity, r.summary, r.status) for r in map(self.rules.get, self.ids())]
        return spark.createDataFrame(rows, "rule_id string, title string, kind string, severity string, summary string, status string")

    def selected(self, *layers: dict[str, list[str]]) -> list[str]:
        """Enabled ids: stable rules, then each layer's ``enable`` and ``disable`` in turn."""
        on = {k for k, r in self.rules.items() if r.status == "stable"}
        for layer in layers:
            enable, disable = layer.get("enable", []), layer.get("disable", [])
            for x in [*enable, *disable]:
                if x not in self.rules:
                    raise ValueError(f"unknown rule: {x}")
            if len({*enable}) < len(enable) or len({*disable}) < len(disable) or {*enable} & {*disable}:
                raise ValueError("a rule is named twice")
            on = (on | {*enable}) - {*disable}
        return sorted(on)


def read_config(text: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Rule selection and options of a TOML text; unknown keys are refused."""
    data = tomllib.loads(text)
    if data.pop("schema_version", None) != 1:
        raise ValueError("schema_version must be 1")
    rules = data.pop("rules", {})
    options = {k: data.pop(k) for k in ("text_type",) if k in data}
    terms = data.pop("glossary", {}).get("terms", [])
    if data or set(rules) - {"enable", "disable"}:
        raise ValueError(f"unknown keys: {sorted(data) + sorted(set(rules) - {'enable', 'disable'})}")
    if len({t.casefold() for t in terms}) < len(terms):
        raise ValueError("a glossary term is there twice")
    if options.get("text_type", "procedural") not in ("procedural", "descriptive"):
        raise ValueError("text_type is procedural or descriptive")
    return rules, options | ({"terms": "\n".join(terms)} if terms else {})


PLACES = ("start_line", "start_column", "end_line", "end_column")


def lint(docs: DataFrame, catalog: Catalog, enabled: Iterable[str], context: Context = Context(), with_context: bool = False) -> DataFrame:
    """Diagnostics of the enabled rules; rules that are off add no branch to the plan. A span outside its text fails the job.
    Documents that can't be read are left out: ``intake.problems`` has a row for each.

    Rules that find lines and columns themselves hand them on; the documents join the spans of the others, once. The same
    holds for the text of a span and the lines around it (``span`` and ``context``), which ``with_context`` adds. Sort with
    ``ordered`` where order matters.
    """
    from .intake import admitted

    docs = admitted(docs)
    wanted = (*PLACES, "span", "context") if with_context else PLACES
    done, open_ = [], []
    for rule_id in enabled:
        rule = catalog.rules[rule_id]
        found = rule.find(docs, context)
        complete = set(wanted) <= set(found.columns)
        found = found.select("uri", "start", "end", F.col("evidence").cast("string").alias("evidence"), *(wanted if complete else ()))
        found = found.withColumns({"rule_id": F.lit(rule_id), "severity": F.lit(rule.severity), "message": F.lit(rule.message)})
        (done if complete else open_).append(found)
    columns = DIAGNOSTIC + wanted[4:]
    if open_:
        done.append(located(reduce(DataFrame.unionByName, open_), docs, with_context))
    if not done:
        kinds = {"start": "int", "end": "int"} | dict.fromkeys(PLACES, "int")
        return docs.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return reduce(DataFrame.unionByName, (df.select(*columns) for df in done))


def located(spans: DataFrame, docs: DataFrame, with_context: bool) -> DataFrame:
    """Spans with places, and with their text and context, from the documents' texts."""
    from ..functions.place import column_of, line_around, line_of

    placed = spans.join(docs.select("uri", "text"), "uri")
    valid = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    start = F.when(valid, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("invalid span from "), F.col("rule_id"))).cast("int"))
    placed = placed.withColumn("start", start.cast("int")).withColumn("end", F.col("end").cast("int"))
    places = {f"{side}_{what}": f(F.col("text"), F.col(side)) for side in ("start", "end") for what, f in (("line", line_of), ("column", column_of))}
    if with_context:
        places |= {"span": F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), "context": line_around(F.col("text"), F.col("start"), F.col("end"))}
    return placed.withColumns(places)


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("uri", "start", "end", "rule_id")
