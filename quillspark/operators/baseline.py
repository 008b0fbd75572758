"""Baselines: fingerprints of known findings, which hold no text, and their suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import collapse
from ..functions.place import line_around


MARK = "sha256:"


def identity() -> Column:
    """Five lines that name a finding by content, so that it survives inserted lines."""
    parts = (F.lit("algorithm=1"), F.concat(F.lit("rule_id="), "rule_id"), F.concat(F.lit("uri="), F.replace("uri", F.lit("\\"), F.lit("/"))), F.concat(F.lit("span="), collapse(F.col("span"))), F.concat(F.lit("context="), collapse(F.col("context"))))
    return F.concat_ws("\n", *parts)


def fingerprints(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """Diagnostics with their fingerprint; the ordinal tells repeated content apart. Diagnostics that have their span and context
    (``lint`` with ``with_context``) need no texts, others join the documents."""
    if not {"span", "context"} <= set(diagnostics.columns):
        text, start, end = F.col("text"), F.col("start"), F.col("end")
        diagnostics = diagnostics.join(docs.select("uri", "text"), "uri").withColumns({"span": F.substring(text, start + 1, end - start), "context": line_around(text, start, end)}).drop("text")
    known = diagnostics.withColumn("identity", identity()).drop("span", "context")
    w = Window.partitionBy("identity").orderBy("uri", "start", "end", "rule_id")
    digest = F.sha2(F.concat("identity", F.lit("\nordinal="), (F.row_number().over(w) - 1).cast("string")), 256)
    return known.withColumn("fingerprint", F.concat(F.lit(MARK), digest)).drop("identity")


def baseline_of(marked: DataFrame) -> DataFrame:
    return marked.select("fingerprint").distinct()


def unknown(marked: DataFrame, baseline: DataFrame) -> DataFrame:
    """Diagnostics that the baseline does not hold."""
    return marked.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def to_json(baseline: DataFrame) -> DataFrame:
    """One row: the baseline as canonical JSON, for baselines that fit a text. ``to_json_parts`` takes any."""
    return listed(baseline.agg(F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"))).select("json")


def to_json_parts(baseline: DataFrame, digits: int = 3) -> DataFrame:
    """part, json: the baseline as canonical JSON texts, one for each beginning of that many digits of the digests. Digests lie evenly,
    so a text holds one in 16 ** ``digits``; in the order of parts their entries are those of the one text."""
    part = F.substring("fingerprint", 1, len(MARK) + digits).alias("part")
    return listed(baseline.groupBy(part).agg(F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"))).select("part", "json")


def listed(lists: DataFrame) -> DataFrame:
    return lists.withColumn("json", F.to_json(F.struct("fingerprints", F.lit("1.0").alias("schema_version"))))


def from_json(text: DataFrame) -> DataFrame:
    """Fingerprints of JSON texts (column json). Unknown keys, other versions and malformed or repeated entries fail, and in texts that
    are parts (column part) entries of another part."""
    part = F.col("part") if "part" in text.columns else F.lit(MARK)
    parsed = text.select(part.alias("part"), F.from_json("json", "fingerprints array<string>, schema_version string", {"mode": "FAILFAST"}).alias("b"), F.json_object_keys("json").alias("keys"))
    fine = (F.sort_array("keys") == F.array(F.lit("fingerprints"), F.lit("schema_version"))) & (F.col("b.schema_version") == "1.0") & (F.size(F.array_distinct("b.fingerprints")) == F.size("b.fingerprints"))
    fine = fine & F.forall("b.fingerprints", lambda x: F.rlike(x, F.lit(f"^{MARK}[0-9a-f]{{64}}$")) & F.startswith(x, F.col("part")))
    return parsed.select(F.explode(F.when(fine, F.col("b.fingerprints")).otherwise(F.raise_error(F.lit("not a baseline")).cast("array<string>"))).alias("fingerprint"))
