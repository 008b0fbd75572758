"""Exact dedup as a stateful stream.

Documents arrive as digests of their normalised texts; a streaming aggregation keyed by digest keeps, in RocksDB on disk
and without expiry, the least stable identifier, the number of arrivals and a content locator of the document that stays:
the file that holds its text, and its identifier. State and arrivals live in a folder, so a later call with the same folder
goes on where the last one ended; such a folder also stores the normalised texts, which are what locators point to. Counts
and minima are formed before the shuffle: a text that makes up a third of all rows sends one row a task to its state.

A digest that was hit more than once is then checked on full bytes, those of earlier calls too: the normalised texts of hit
digests are grouped as they are. Should two texts share a digest, its documents are grouped by text instead.

Defined cases: a null text counts as empty, and empty texts are equal to each other; of rows with one id and one text all
count in the size and ``keep_first`` leaves one; null ids never stay before others; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, quoted, scratch_path, spread, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # without it every store sets some megabytes of disk aside for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: F.Column) -> F.Column:
    """Each run of white space (space, tab to carriage return) as one space; null as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.regexp_replace(out, "  +", " ")


def digested(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """id, norm, file (where the row was read, empty if it was not), sha, digest."""
    kept = spread(docs.select(quoted(id_col).cast("long").alias("id"), normalised(quoted(text_col)).alias("norm"), F.input_file_name().alias("file")))
    return kept.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, digest_bits // 4))


def streamed(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """Runs the stream over what has arrived in the folder since the last run; the state of every digest ever seen."""
    arrivals = spark.readStream.schema("id long, sha string, digest string, locator string").option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/arrivals")
    place = F.struct(F.col("id").isNull(), "id", "locator")
    state = arrivals.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("arrived"), F.min(place).alias("place"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("digest", "keep_id", "arrived", F.col("place.locator").alias("locator")).write.mode("overwrite").parquet(f"{folder}/state-rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema("digest string, keep_id long, arrived long, locator string").parquet(f"{folder}/state-rows/batch=*")
    # a digest has a row for each batch that changed it; identifiers only fall and counts only grow
    return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("arrived").alias("group_size"), F.max_by("locator", "arrived").alias("keep_locator"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, files_per_batch: int = 4096, digest_bits: int = 256) -> DataFrame:
    """(id, keep_id, group_size, text_sha256, keep_locator): a row per document of ``docs``.

    folder: a shared folder whose state goes on; by default a fresh one. files_per_batch bounds a micro-batch.
    """
    spark = docs.sparkSession
    lasting = folder is not None
    folder = folder or scratch_path(spark, "exact")
    texts = digested(docs, id_col, text_col, digest_bits)
    contents = texts
    if lasting:
        own = f"{folder}/contents/call={uuid.uuid4().hex}"
        texts.drop("file").write.parquet(own)
        stored = spark.read.schema("id long, norm string, sha string, digest string")
        texts = stored.parquet(own).withColumn("file", F.input_file_name())
        contents = stored.parquet(f"{folder}/contents/call=*")
    arrived = texts.select("id", "sha", "digest", F.concat_ws("#", "file", F.col("id").cast("string")).alias("locator"))
    now = written(arrived, "arrived") if lasting else arrived
    now.write.mode("append").parquet(f"{folder}/arrivals")
    own_rows = now if lasting else spark.read.schema(arrived.schema).parquet(f"{folder}/arrivals")
    groups = written(streamed(spark, folder, files_per_batch), "groups")

    # full bytes of the hits
    hits = groups.filter("group_size > 1").select("digest")
    if lasting:
        hits = hits.join(now.select("digest"), "digest", "left_semi")
    variants = contents.select("id", "digest", "norm").join(hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    clashing = written(variants.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "clashing")
    columns = ["id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), "keep_locator"]
    if clashing.isEmpty():
        return own_rows.select("id", "sha", "digest").join(groups, "digest").select(*columns)
    whole = own_rows.select("id", "sha", "digest").join(clashing, "digest", "left_anti").join(groups, "digest")
    split = texts.join(clashing, "digest", "left_semi").select("id", "sha", "norm", "file")
    by_text = contents.join(clashing, "digest", "left_semi").groupBy("norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    split = split.join(by_text, "norm").withColumn("keep_locator", F.when(F.col("id").eqNullSafe(F.col("keep_id")), F.concat_ws("#", "file", F.col("id").cast("string"))))
    return whole.select(*columns).unionByName(split.select(*columns))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    groups = exact_groups(docs, id_col, text_col)
    stay = groups.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("id", "text_sha256").agg(F.count("*").alias("rows"))
    stay = written(stay, "stay")
    tag, same = free_name(docs, "_sha"), free_name(docs, "_row")
    key = stay.select(F.col("id").alias(free_name(docs, "_stay")), F.col("text_sha256").alias(f"{tag}2"), "rows")
    kept = docs.withColumn(tag, F.sha2(normalised(quoted(text_col)), 256))
    once = key.filter("rows = 1").drop("rows")
    out = kept.join(once, quoted(id_col).eqNullSafe(F.col(once.columns[0])) & (F.col(tag) == F.col(f"{tag}2")), "left_semi")
    if not key.filter("rows > 1").isEmpty():  # repeated rows: one of each stays
        more = key.filter("rows > 1").drop("rows")
        again = kept.join(more, quoted(id_col).eqNullSafe(F.col(more.columns[0])) & (F.col(tag) == F.col(f"{tag}2")), "left_semi")
        again = again.withColumn(same, F.row_number().over(Window.partitionBy(quoted(id_col), tag).orderBy(*(quoted(c) for c in docs.columns))))
        out = out.unionByName(again.filter(F.col(same) == 1).drop(same))
    return out.select(*(quoted(c) for c in docs.columns))
