"""Overlap of corpora: how many distinct texts two sides share, as they are and under two normalisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import SPACE, collapse
from .vocabulary import folded


def forms(texts: DataFrame, column: str = "text") -> DataFrame:
    """(form, value) of each text: exact; collapsed (NFC, case folded, single blanks); squeezed (without white space)."""
    base = collapse(folded(column))
    pairs = F.array(F.struct(F.lit("exact").alias("form"), F.col(column).alias("value")), F.struct(F.lit("collapsed").alias("form"), base.alias("value")), F.struct(F.lit("squeezed").alias("form"), F.regexp_replace(base, rf"[{SPACE}]+", "").alias("value")))
    return texts.filter(F.col(column).isNotNull()).select(F.inline(pairs)).distinct()


def shared(left: DataFrame, right: DataFrame, column: str = "text") -> DataFrame:
    """form, n: distinct texts that both sides have, zero included."""
    both = forms(left, column).intersect(forms(right, column)).groupBy("form").agg(F.count("*").alias("n"))
    names = left.sparkSession.createDataFrame([("exact",), ("collapsed",), ("squeezed",)], "form string")
    return names.join(both, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"))


ANCHOR_WORDS = 4


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc, passage) where a document's text holds a passage's. docs: doc, text. passages: passage, text.

    The words inside a passage (all but its first and last, which the document may continue) stand in the document as they are.
    Up to four of them, from the second on, are a passage's anchor: anchors are joined by hash with all runs of as many words of
    the documents, and only such pairs are verified on the texts. A passage of under three words has nothing inside and is
    looked for in every document. Null texts hold nothing and are not held."""
    cut = lambda text: F.split(text, rf"[{SPACE}]+")
    texts, wanted = docs.filter("text is not null"), passages.filter("text is not null").select("passage", F.col("text").alias("wanted"))
    told = wanted.withColumn("w", cut(F.col("wanted"))).withColumn("n", F.least(F.lit(ANCHOR_WORDS), F.size("w") - 2))
    anchors = told.filter("n > 0").select("passage", "n", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("anchor"))
    sizes = [r["n"] for r in anchors.select("n").distinct().collect()]  # four at most
    words = texts.select("doc", cut(F.col("text")).alias("w"))

    def runs(n: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.size("w") - n + 1)
        every = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))))
        return words.filter(F.size("w") >= n).select("doc", F.lit(n).alias("n"), F.explode(every).alias("anchor"))

    pairs = reduce(DataFrame.unionByName, [runs(n) for n in sizes] or [words.select("doc", F.lit(0).alias("n"), F.lit(0).cast("long").alias("anchor")).limit(0)])
    near = pairs.join(anchors, ["n", "anchor"]).select("doc", "passage").distinct()
    long = near.join(texts, "doc").join(wanted, "passage").filter(F.contains("text", "wanted")).select("doc", "passage")
    short = texts.join(told.filter("n <= 0").select("passage", "wanted"), F.contains("text", "wanted")).select("doc", "passage")
    return long.unionByName(short)
