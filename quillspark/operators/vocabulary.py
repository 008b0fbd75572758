"""Controlled vocabulary: strict import, and look-up of words as matched, ambiguous, missing or technical."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FIELDS = ("term", "part_of_speech", "meaning_id", "case_sensitive")
MOST_BYTES, MOST_ENTRIES = 16 << 20, 100_000


@F.pandas_udf(StringType())
def other_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(StringType())
def other_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def only_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def folded(column: str | Column) -> Column:
    """NFC, then case-folded. For ASCII that is lower case; only other texts go to Python (nulls do for the rest)."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(only_ascii(text), F.lower(text)).otherwise(other_folded(F.when(~only_ascii(text), text)))


def nfc(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.when(only_ascii(text), text).otherwise(other_nfc(F.when(~only_ascii(text), text)))


def read_source(text: str) -> list[dict]:
    """Entries of a vocabulary in JSON. Repeated keys, unknown fields, padding, texts not in NFC and clashes are refused."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the vocabulary is too large")

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is there twice")
        return dict(pairs)

    def refuse(x: str):
        raise ValueError(f"not a number: {x}")

    entries = json.loads(text, object_pairs_hook=once, parse_constant=refuse)["entries"]
    if len(entries) > MOST_ENTRIES:
        raise ValueError("the vocabulary has too many entries")
    seen: dict[tuple, list[dict]] = {}
    for e in entries:
        if sorted(e) != sorted(FIELDS) or not isinstance(e["case_sensitive"], bool):
            raise ValueError(f"not an entry: {e}")
        for k in FIELDS[:3]:
            if not e[k] or e[k] != e[k].strip() or unicodedata.normalize("NFC", e[k]) != e[k]:
                raise ValueError(f"{k} must be trimmed NFC text")
        same = seen.setdefault((e["part_of_speech"], e["meaning_id"], e["term"].casefold()), [])
        if any(x["term"] == e["term"] or not (x["case_sensitive"] and e["case_sensitive"]) for x in same):
            raise ValueError(f"an entry is there twice: {e['term']}")
        same.append(e)
    return entries


def clashes(entries: DataFrame) -> DataFrame:
    """part_of_speech, meaning_id, fold, entries of a vocabulary table whose terms are one when case is folded: several entries, of
    which one does not tell case apart or two are written alike."""
    own = entries.withColumn("fold", folded("term")).groupBy("part_of_speech", "meaning_id", "fold")
    counted = own.agg(F.count("*").alias("entries"), F.count_distinct("term").alias("terms"), F.bool_and("case_sensitive").alias("cased"))
    return counted.filter("entries > 1 and (not cased or terms < entries)").select("part_of_speech", "meaning_id", "fold", "entries")


def content_hash(entries: list[dict]) -> str:
    lines = sorted(json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for e in entries)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def to_resource(entries: list[dict]) -> str:
    """The vocabulary as canonical JSON, with the hash of its content."""
    listed = sorted(entries, key=lambda e: json.dumps(e, sort_keys=True, ensure_ascii=False))
    return json.dumps({"content_hash": content_hash(entries), "entries": listed}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def from_resource(text: str) -> list[dict]:
    """Entries of a resource whose hash is that of its content; they are checked as a source's are."""
    entries = read_source(text)
    if json.loads(text).get("content_hash") != content_hash(entries):
        raise ValueError("the resource is not what its hash says")
    return entries


def cached(source: str, folder: str, consent: bool) -> Path:
    """Imports a source into a folder under the name of its bytes' hash, once, and returns the file. Nothing is kept without
    consent. A file that is there is checked, not written again."""
    if not consent:
        raise ValueError("a vocabulary is kept only with explicit consent")
    entries = read_source(source)
    path = Path(folder) / f"{hashlib.sha256(source.encode()).hexdigest()}.json"
    if path.exists():
        if from_resource(path.read_text(encoding="utf-8")) != json.loads(to_resource(entries))["entries"]:
            raise ValueError("the cached resource is of another source")
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(f".{os.getpid()}.part")
    part.write_text(to_resource(entries), encoding="utf-8", newline="\n")
    part.replace(path)
    return path


def table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [tuple(e[k] for k in FIELDS) for e in entries]
    return spark.createDataFrame(rows, "term string, part_of_speech string, meaning_id string, case_sensitive boolean")


def look_up(words: DataFrame, vocabulary: DataFrame, technical: list[str] = (), part_of_speech: str | None = None, meaning_id: str | None = None) -> DataFrame:
    """``words`` (word) with status and matches. Technical terms win; the vocabulary is joined on the folded term."""
    v = vocabulary
    for name, value in (("part_of_speech", part_of_speech), ("meaning_id", meaning_id)):
        if value is not None:
            v = v.filter(F.col(name) == value)
    v = v.withColumn("fold", folded("term"))
    terms = words.select("word").distinct().withColumn("fold", folded("word"))
    fits = ~F.col("case_sensitive") | (F.col("term") == nfc("word"))
    counted = terms.join(v, "fold", "left").groupBy("word", "fold").agg(F.count(F.when(F.col("term").isNotNull() & fits, 1)).alias("matches"))
    is_technical = F.col("fold").isin([unicodedata.normalize("NFC", t).casefold() for t in technical]) if technical else F.lit(False)
    status = F.when(is_technical, "technical").when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return words.join(counted.select("word", status.alias("status"), F.when(is_technical, 0).otherwise(F.col("matches")).alias("matches")), "word")
