"""Holdout sampling: occurrence units, deterministic samples, review packets, frozen digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.place import window_around
from .inventory import positioned
from .plain import marks


def occurrences(docs: DataFrame, needle: str = ";") -> DataFrame:
    """Every occurrence of a character: uri, ordinal from 1, offset, byte offset, line, column. A null text has none."""
    found = marks(docs.select("uri", F.coalesce("text", F.lit("")).alias("text")), needle)
    return found.select("uri", "ordinal", F.col("start").alias("offset"), "byte_offset", F.col("start_line").alias("line"), F.col("start_column").alias("column"))


def hash_sample(docs: DataFrame, key: F.Column, salt: str, k: int) -> DataFrame:
    """The k rows with the least SHA-256 of salt, NUL, key: the same sample on every run."""
    rank = F.sha2(F.concat(F.lit(salt), F.lit("\0"), key), 256)
    return docs.withColumn("selection_sha256", rank).orderBy("selection_sha256").limit(k)


def numbered(units: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Case ids prefix-0001... in a global order, without a window over all rows."""
    out = positioned(units, order, "_number")
    digits = F.col("_number").cast("string")
    return out.withColumn("case_id", F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))).drop("_number")


def review_packet(units: DataFrame, docs: DataFrame, radius: int = 2) -> DataFrame:
    """Units with the lines around them and their digest, safe to open in a spreadsheet."""
    shown = units.join(docs.select("uri", "text"), "uri").withColumn("context", window_around(F.col("text"), F.col("line"), radius))
    return shown.withColumn("context_sha256", F.sha2("context", 256)).withColumn("context", csv_safe(F.col("context"))).drop("text")


def csv_safe(value: F.Column) -> F.Column:
    """A leading character that a spreadsheet would take for a formula is quoted."""
    return F.when(F.rlike(value, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), value)).otherwise(value)


def changed_fields(sent: DataFrame, returned: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Returned rows whose fixed fields are not as they were sent (nulls compare), or that were not sent."""
    both = sent.alias("s").join(returned.alias("r"), key, "full_outer")
    same = F.lit(True)
    for name in fixed:
        same = same & F.col(f"s.{name}").eqNullSafe(F.col(f"r.{name}"))
    return both.filter(~same).select(key)


def combined_digest(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over "path NUL sha LF" of all files (path, sha256) in order of path."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("files"))
