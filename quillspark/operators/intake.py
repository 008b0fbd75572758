"""What documents can be read: an error row for each that can't, so that the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plain import MOST_CHARS

UNSUPPORTED, TOO_LONG = "unsupported_format", "too_long"


def told_format() -> Column:
    """The format that the suffix of a uri tells, in any case; null if it tells none."""
    low = F.lower("uri")
    return F.when(low.endswith(".txt"), "plain").when(low.endswith(".md") | low.endswith(".markdown"), "markdown")


def problem() -> Column:
    """Why a document (uri, text) is not read, or null."""
    return F.when(told_format().isNull(), UNSUPPORTED).when(F.length("text") > MOST_CHARS, TOO_LONG)


def problems(docs: DataFrame) -> DataFrame:
    """uri, code, chars: a row for each document that is not read."""
    return docs.select("uri", problem().alias("code"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")).filter("code is not null")


def admitted(docs: DataFrame) -> DataFrame:
    """The documents that are read."""
    return docs.filter(problem().isNull())


def exit_code(findings: int, errors: int, *others: int) -> int:
    """0 without findings, 1 with some, 2 if a document or step failed, whatever was found; of several runs the highest."""
    return max(2 if errors else int(findings > 0), *others, 0)
