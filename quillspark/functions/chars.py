"""Character classes, once for Spark's regular expressions and once for RE2 (as the SQL side uses)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
SPACE = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RE2 = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Never \w: engines disagree on combining marks.
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = rf"[{SPACE}]+|{WORD_CHAR}+(?:[-']{WORD_CHAR}+)*|[^{SPACE}\p{{L}}\p{{N}}_]"
TOKEN_RE2 = rf"[{SPACE_RE2}]+|[\p{{L}}\p{{N}}_]+(?:[-'][\p{{L}}\p{{N}}_]+)*|[^{SPACE_RE2}\p{{L}}\p{{N}}_]"
SENTENCE = r"[^.!?]*[.!?]|[^.!?]+"


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def leading(text: Column) -> Column:
    """Number of white-space characters at the start."""
    return F.length(text) - F.length(F.regexp_replace(text, rf"^[{SPACE}]+", ""))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def has_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{L}"))
