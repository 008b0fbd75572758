"""The registered queries of the corpus operators: thin forms that derive contract columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ctw, exactdedup, htmlblocks, linededup, minhash, mixing, packing, quality, search, secrets, toxicity, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(shown(F.filter("spans", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )


def op2_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its base and model scores."""
    return ctw.scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed span of a repeated passage."""
    return linededup.repeated_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").withColumnRenamed("first_id", "first_doc_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its set size and component."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the row that stays for its text."""
    found = exactdedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its record as read back from the archives."""
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("header_digest"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts, base verdict, distance and final verdict."""
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "distance")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page with its main text."""
    found = htmlblocks.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and pass in which it is seen."""
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "mix_pass", "mix_block", "mix_tokens", *(F.col("mix_order")[i].alias(f"mix_order_{i}") for i in range(3)))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens of both kinds, their groups, and how its links count in the corpus."""
    found = alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per item: the documents that score highest."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its score of toxicity."""
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_ctw_scores, op3_line_dedup, op4_mix_sources, op5_exact_dedup, op6_warc_round_trip, op7_near_duplicates, op8_quality_outliers, op9_html_main_text,
        op10_pack_sequences, op11_token_alignment, op12_lexical_search, op13_toxicity_scores,
    )
}

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             g AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
    "op12_lexical_search": f"""
        WITH i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)),
             d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents),
             s AS (SELECT sum(CASE WHEN len(terms) > 0 THEN 1 ELSE 0 END)::BIGINT AS nn, sum(len(terms))::BIGINT AS ll FROM d),
             p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
                   FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
             w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
             x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)) AS f FROM p, s),
             g AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * f)::BIGINT AS score FROM i JOIN x USING (term) JOIN w USING (term) GROUP BY item_id, r)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM g WHERE score > 0)
        WHERE rank <= 10""",
}
