"""Records of reviews and model answers: extraction, verification, places of excerpts, formats."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chars import SPACE, WORD_CHAR, collapse


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?[ \t]*\n(.*?)\n?```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(answer))


def greedy_object(answer: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(unfenced(answer), r"(?s)\{.*\}", 0)


@F.pandas_udf(StringType())
def balanced_object(answers: pd.Series) -> pd.Series:
    """The last JSON object of an answer that parses, as canonical text; null if none does."""

    def last(text: str | None) -> str | None:
        found, at, decode = None, 0, json.JSONDecoder().raw_decode
        while text and (at := text.find("{", at)) >= 0:
            try:
                value, at = decode(text, at)
                found = value if isinstance(value, dict) else found
            except ValueError:
                at += 1
        return None if found is None else json.dumps(found, sort_keys=True, ensure_ascii=False)

    return answers.map(last)


PAYLOAD = "output array<struct<type:string,content:array<struct<type:string,text:string>>>>"


def payload_text(payload: Column) -> Column:
    """The text of the first message of a stored model response; null without one."""
    messages = F.filter(F.from_json(payload, PAYLOAD)["output"], lambda m: m["type"] == "message")
    texts = F.filter(F.try_element_at(messages, F.lit(1))["content"], lambda c: c["type"] == "output_text")
    return F.try_element_at(texts, F.lit(1))["text"]


def verified(findings: DataFrame, categories: list[str], severities: list[str]) -> DataFrame:
    """Findings (case, text, category, severity, excerpt, seq) with a reason to reject them, or null: unknown category or
    severity, an excerpt that is empty or not in the text (white space aside), or one reported before."""
    excerpt = collapse(F.col("excerpt"))
    reason = (
        F.when(~F.col("category").isin(categories), "category").when(~F.col("severity").isin(severities), "severity")
        .when(F.coalesce(excerpt, F.lit("")) == "", "empty_excerpt").when(~F.contains(collapse(F.col("text")), excerpt), "not_verbatim")
    )
    marked = findings.withColumns({"reason": reason, "shown": excerpt})
    w = Window.partitionBy("case", "category", "shown", F.col("reason").isNull()).orderBy("seq")
    again = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return marked.withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("shown")


def ordered_places(text: Column, fragments: Column) -> Column:
    """Start of each fragment, looked for from the end of the one before; null if one is not there."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"), F.lit(True).alias("ok"))

    def go(acc: Column, f: Column) -> Column:
        place = F.position(f, text, acc["at"])
        return F.struct((place + F.length(f)).alias("at"), F.array_append(acc["found"], place - 1).alias("found"), (acc["ok"] & (place > 0)).alias("ok"))

    return F.aggregate(fragments, start, go, lambda acc: F.when(acc["ok"], acc["found"]))


def protected_tokens(text: Column, forms: list[str]) -> Column:
    """Words, with protected forms kept whole (the longest first)."""
    word = rf"(?:{WORD_CHAR}|\p{{M}})+"
    kept = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    return F.regexp_extract_all(text, F.lit((kept + "|" if kept else "") + rf"{word}(?:[-'’]{word})*|[^{SPACE}]"), F.lit(0))


def is_iso_date(value: Column) -> Column:
    """A real day written YYYY-MM-DD."""
    return F.coalesce(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def newline_fault(text: Column) -> Column:
    """A lone CR or a separator other than LF and CRLF, by name; null if there is none."""
    return F.when(F.rlike(text, F.lit(r"\r(?!\n)")), "lone_cr").when(F.rlike(text, F.lit(r"[\x0b\x0c\x1c-\x1e\x85  ]")), "separator")


def alternating(cases: DataFrame, key: str) -> DataFrame:
    """Cases with the side, A or B, that their control run is shown on: in turn by order of the key. Places come from range
    partitions, not from a window over all cases."""
    from ..operators.inventory import positioned

    placed = positioned(cases, [key], "_place")
    return placed.withColumn("control_side", F.when(F.col("_place") % 2 == 1, "A").otherwise("B")).drop("_place")


def resumed(kept: DataFrame, wanted: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid results that are there, and the wanted keys that have none yet."""
    valid = kept.filter("valid").dropDuplicates(on)
    return valid, wanted.join(valid.select(*on), on, "left_anti")


def normal_score(scores: DataFrame, classes: list[str], fallback: str) -> DataFrame:
    """Reviewer scores with clarity clamped to 1..5, unknown classes as the fallback, and notes cut to 240 characters."""
    known = F.when(F.col("accept_class").isin(classes), F.col("accept_class")).otherwise(fallback)
    return scores.withColumns({"clarity": F.least(F.greatest(F.col("clarity"), F.lit(1)), F.lit(5)), "accept_class": known, "notes": F.substring("notes", 1, 240)})

