"""Linting documents as they arrive: the batch transform of plain sentences, without a window by document.

An adaptation, since the rules themselves know no streams. A folder is watched; each file is one document, read whole. A
document is walked where it lies, so nothing is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plain import sentences, simple_words
from ..operators.rules import LIMITS


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """uri, text of text files as they come into a folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return raw.select(F.input_file_name().alias("uri"), F.col("value").alias("text"))


def long_sentences(docs: DataFrame, text_type: str = "procedural") -> DataFrame:
    """uri, start, end, words of sentences over the limit; runs on streams and on tables alike."""
    counted = sentences(docs).filter("complete").withColumn("words", simple_words(F.col("text")))
    return counted.filter(F.col("words") > LIMITS[text_type]).select("uri", "start", "end", "words")
