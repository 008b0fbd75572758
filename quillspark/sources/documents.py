"""Readers of documents and of records whose bytes were frozen."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, exclude: list[str] = (), exclude_files: list[str] = ()) -> DataFrame:
    """uri, text of .txt, .md and .markdown files under a path. Bytes are decoded strictly, line ends stay, and what is not
    UTF-8 fails; folders in ``exclude`` and the files in ``exclude_files`` (by the ends of their paths) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}").load(path)
    for prefix in exclude:
        files = files.filter(~F.rlike("path", F.lit("/" + re.escape(prefix.strip("/")) + "(?:/|$)")))
    for name in exclude_files:
        files = files.filter(~F.endswith("path", F.lit("/" + name.strip("/"))))
    return files.select(F.col("path").alias("uri"), F.validate_utf8(F.col("content").cast("string")).alias("text"))


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Files that are not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("path").alias("uri"), F.length("content").alias("bytes"))


def read_frozen_json(spark: SparkSession, path: str, sha256: str, schema: str) -> DataFrame:
    """Rows of a JSONL file whose bytes have a given digest; else, or if a line is malformed, the job fails."""
    file = spark.read.format("binaryFile").load(path)
    text = F.when(F.sha2("content", 256) == sha256, F.col("content").cast("string")).otherwise(F.raise_error(F.lit(f"{path} has changed")))
    rows = file.select(F.explode(F.split(text, "\n")).alias("line")).filter("line <> ''")
    return rows.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """sent, text, block of each sentence: blocks between empty lines are records of the text source."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter("value rlike '\\\\S'")
    comment = lambda name: F.regexp_extract("value", rf"(?m)^# {name} = (.*)$", 1)
    return blocks.select(comment("sent_id").alias("sent"), comment("text").alias("text"), F.col("value").alias("block"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a corpus with "form|pos|tag" items a line (also compressed): text, forms."""
    items = F.filter(F.split("value", " "), lambda x: F.contains(x, F.lit("|")))
    forms = F.transform(items, lambda x: F.substring_index(x, "|", 1))
    return spark.read.text(path).filter("value <> ''").select(F.array_join(forms, " ").alias("text"), forms.alias("forms"))


def table_documents(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text", suffix: str = ".txt") -> DataFrame:
    """A table of texts as documents: uri is the key with a suffix that tells the format."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("uri"), F.col(text).alias("text"), F.col(key).alias("key"))
