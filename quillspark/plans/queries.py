"""Registered queries over the given tables. Each has SQL beside it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions.place import only_place
from ..functions.ratio import ratio
from ..operators import baseline, holdout, metrics, overlap, plain, rules, scanner, study, vocabulary
from ..operators.catalog import Context, lint
from ..sources.documents import table_documents
from ..sources.reports import json_reports, read_json_reports
from . import sqlparts as sql
from .registry import ORACLES, QUERIES, query  # noqa: F401


#: Documents of a task, on average.
TASK_DOCS = 4_000


def spread_documents(spark: SparkSession, sf_dir: str, **how: str) -> DataFrame:
    """Documents dealt to all cores, in shares that do not grow with the table: a row group of a file is one task's work, however
    large it is."""
    docs = table_documents(spark, sf_dir, **how)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCS))
    return docs.repartition(tasks, "uri") if len(docs.inputFiles()) < tasks else docs


def key(name: str = "uri") -> F.Column:
    return F.substring_index(name, ".", 1).cast("long").alias("doc_id")


def long_ones(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    docs = spread_documents(spark, sf_dir)
    found = plain.sentences(docs).filter("complete").withColumn("words", plain.simple_words(F.col("text"))).filter(F.col("words") > limit)
    return found.select(key(), *(F.col(c).cast("long") for c in ("start", "end", "words", "line", "column")))


@query(sql.long_sentences(20))
def sent001_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_ones(spark, sf_dir, 20)


@query(sql.long_sentences(25))
def sent002_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_ones(spark, sf_dir, 25)


@query(f"""WITH {sql.SENTENCES} SELECT doc_id, ordinal::BIGINT AS ordinal, "start", "end", complete, md5(s) AS text_md5 FROM sentences""")
def sentences_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.sentences(spread_documents(spark, sf_dir)).select(key(), F.col("ordinal").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), "complete", F.md5("text").alias("text_md5"))


@query(rf"""WITH {sql.TOKENS} SELECT doc_id, count(*) AS tokens, count(*) FILTER (regexp_matches(token, '\p{{L}}')) AS words, count(*) FILTER (token = '.') AS periods FROM cut GROUP BY doc_id""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract_all("text", F.lit(plain.TOKEN), F.lit(0))
    docs = spread_documents(spark, sf_dir).filter("text <> ''").withColumn("t", t)
    count = lambda f: F.size(F.filter("t", f)).cast("long")
    return docs.select(key(), F.size("t").cast("long").alias("tokens"), count(lambda x: F.rlike(x, F.lit(r"\p{L}"))).alias("words"), count(lambda x: x == ".").alias("periods"))


@query(f"""WITH {sql.TOKENS} SELECT doc_id, (k - 1)::BIGINT AS ordinal, (sum(length(token)) OVER w - length(token))::BIGINT AS "start", (sum(length(token)) OVER w)::BIGINT AS "end", token
    FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.tokens(spread_documents(spark, sf_dir)).select(key(), F.col("ordinal").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("text").alias("token"))


@query(f"""WITH {sql.TOKENS} SELECT (SELECT count(*) FROM documents WHERE text <> '') AS documents,
    (SELECT count(*) FROM (SELECT doc_id, string_agg(token, '' ORDER BY k) AS t FROM cut GROUP BY doc_id) JOIN documents USING (doc_id) WHERE t <> text) AS faulty""")
def lossless_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_documents(spark, sf_dir)
    bad = plain.token_faults(docs).agg(F.count("*").alias("faulty"))
    return docs.filter("text <> ''").agg(F.count("*").alias("documents")).join(bad)


@query(rf"""WITH {sql.TOKENS} SELECT doc_id, count(*) AS words FROM cut WHERE regexp_matches(token, '\p{{L}}') GROUP BY doc_id""")
def lintable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_documents(spark, sf_dir).select(key(), plain.lintable_words(F.col("text")).cast("long").alias("words")).filter("words > 0")


@query(rf"""WITH {sql.SENTENCES} SELECT doc_id, min(length(text) - length(ltrim(text)))::BIGINT AS "start", count(*) AS sentences FROM sentences WHERE text NOT SIMILAR TO '(.|\n)*\n[ \t]*\n(.|\n)*'
    GROUP BY doc_id HAVING bool_and(complete) AND count(*) > 6""")
def para001_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.long_paragraphs(spread_documents(spark, sf_dir), Context({"text_type": "descriptive"}))
    return found.select(key(), F.col("start").cast("long"), F.regexp_extract("evidence", r"=(\d+)", 1).cast("long").alias("sentences"))


PAGE_SEMICOLONS = """WITH cut AS (SELECT page_id, html, unnest(l) AS piece, generate_subscripts(l, 1) AS k, len(l) AS n FROM (SELECT page_id, html, string_split(html, ';') AS l FROM pages)),
    found AS (SELECT page_id, html, k, (sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS off, n FROM cut)"""


@query(f"""{PAGE_SEMICOLONS} SELECT page_id AS doc_id, off AS "start", {sql.place("html", "off")} FROM found WHERE k < n""")
def semicolon_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_documents(spark, sf_dir, "pages", "page_id", "html")
    found = rules.semicolons(docs, Context())
    return found.select(key(), *(F.col(c).cast("long").alias(n) for c, n in (("start", "start"), ("start_line", "line"), ("start_column", "column"))))


@query()
def semicolon_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as Markdown: semicolons outside tags, comments, entities and so on."""
    found = lint(table_documents(spark, sf_dir, "pages", "page_id", "html", ".md"), rules.CATALOG, ["SEMI-001"])
    return found.select(key(), "start", "end", "start_line", "start_column")


@query(f"""{PAGE_SEMICOLONS} SELECT page_id AS doc_id, k::BIGINT AS ordinal, off AS "offset", strlen(left(html, off::INT))::BIGINT AS byte_offset, {sql.place("html", "off")} FROM found WHERE k < n""")
def occurrence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = holdout.occurrences(table_documents(spark, sf_dir, "pages", "page_id", "html"))
    return found.select(key(), *(F.col(c).cast("long") for c in ("ordinal", "offset", "byte_offset", "line", "column")))


@query(f"""WITH {sql.SENTENCES} SELECT doc_id, "start", {sql.place("text", '"end"')} FROM sentences WHERE complete""")
def line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plain.sentences(spread_documents(spark, sf_dir)).filter("complete")
    return found.select(key(), F.col("start").cast("long"), F.col("end_line").cast("long").alias("line"), F.col("end_column").cast("long").alias("column"))


@query(f"""WITH {sql.SPANS} SELECT doc_id, "start", md5(split_part(left(text, "start"::INT), chr(10), -1) || s || split_part(substr(text, "end"::INT + 1), chr(10), 1)) AS context_md5 FROM spans""")
def context_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = rules.long_sentences("procedural")(spread_documents(spark, sf_dir), Context({"text_type": "procedural"}))
    return spans.select(key(), F.col("start").cast("long"), F.md5("context").alias("context_md5"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_documents(spark, sf_dir)
    return baseline.fingerprints(lint(docs, rules.CATALOG, ["SENT-001"], Context({"text_type": "procedural"}), with_context=True), docs)


@query(f"""WITH {sql.PRINTS} SELECT doc_id, "start", fingerprint FROM prints""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select(key(), F.col("start").cast("long"), "fingerprint")


@query(f"""WITH {sql.PRINTS} SELECT doc_id, "start" FROM prints WHERE fingerprint NOT IN (SELECT fingerprint FROM prints WHERE doc_id IN (SELECT doc_id FROM labels))""")
def baseline_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a baseline of the labelled documents' findings does not hold."""
    found = marked(spark, sf_dir).withColumn("doc_id", key())
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return baseline.unknown(found, baseline.baseline_of(found.join(labelled, "doc_id", "left_semi"))).select("doc_id", F.col("start").cast("long"))


@query("SELECT 0::BIGINT AS left_over")
def baseline_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(spark, sf_dir)
    return baseline.unknown(found, baseline.from_json(baseline.to_json_parts(baseline.baseline_of(found)))).agg(F.count("*").alias("left_over"))


@query("SELECT doc_id, sha256('holdout' || chr(0) || doc_id || '.txt') AS selection_sha256 FROM documents ORDER BY 2 LIMIT 50")
def hash_sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents with the least digests: a deterministic sample."""
    return holdout.hash_sample(table_documents(spark, sf_dir).select("uri"), F.col("uri"), "holdout", 50).select(key(), "selection_sha256")


def labelled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: reported if a sentence is too long, labelled from the quality table (a stand-in for reviews)."""
    docs = spread_documents(spark, sf_dir)
    spans = rules.long_sentences("procedural")(docs, Context({"text_type": "procedural"}))
    facts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri"))
    label = F.when(F.col("toxic").isNull(), "ambiguous").when(F.col("quality") == 0, "out_of_scope").when(F.col("toxic") == 1, "violation").otherwise("non_violation")
    units = facts.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").withColumn("label", label)
    return metrics.emitted(units, spans, ["uri"])


@query(f"""WITH {sql.SPANS}, {sql.UNITS} SELECT source, 'strict' AS convention, {sql.STRICT} FROM units GROUP BY source UNION ALL SELECT source, 'conservative', {sql.CONSERVATIVE} FROM units GROUP BY source""")
def unit_label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = labelled_units(spark, sf_dir)
    both = [metrics.confusion(units, ["source"], c).withColumn("convention", F.lit(c)) for c in ("strict", "conservative")]
    return both[0].unionByName(both[1])


@query(f"""WITH {sql.SPANS}, {sql.UNITS} SELECT source, {sql.HOLDOUT} FROM units GROUP BY GROUPING SETS ((source), ())""")
def holdout_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_with_total(labelled_units(spark, sf_dir), "source")


_P, _R = sql.wilson("tp", "tp + fp"), sql.wilson("tp", "tp + fn")


@query(f"""WITH {sql.SPANS}, {sql.UNITS}, m AS (SELECT source, {sql.HOLDOUT} FROM units GROUP BY GROUPING SETS ((source), ()))
    SELECT source, tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 9) AS f1,
    {_P[0]} AS precision_low, {_P[1]} AS precision_high, {_R[0]} AS recall_low, {_R[1]} AS recall_high FROM m""")
def wilson_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.with_metrics(holdout_by_domain(spark, sf_dir))
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(f"""WITH {sql.SPANS}, {sql.UNITS}, m AS (SELECT source, {sql.HOLDOUT} FROM units GROUP BY source), t AS (SELECT source, tp AS k, fp, unnest(range(0, tp + fp + 100)) AS extra FROM m)
    SELECT source, min(extra) FILTER ({sql.wilson("k + extra", "k + fp + extra")[0]} >= 0.5)::BIGINT AS extra_tp FROM t GROUP BY source""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = metrics.confusion(labelled_units(spark, sf_dir), ["source"], "holdout")
    return metrics.extra_hits_needed(matrix, goal=0.5).select("source", F.col("extra_tp").cast("long"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, (d.doc_id IS NOT NULL)::INT::BIGINT AS n_left, (l.doc_id IS NOT NULL)::INT::BIGINT AS n_right
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id")
    return metrics.unmatched_keys(read("documents"), read("labels"), ["doc_id"])


@query(f"""WITH {sql.SPANS}, {sql.UNITS} SELECT lang, source, count(*) AS units, count(*) FILTER (emitted) AS emitted FROM units GROUP BY ROLLUP (lang, source)""")
def rule_units_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_units(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("units"), F.count_if("emitted").alias("emitted"))


_SENT = "SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda x: trim(regexp_replace(x, '[" + sql.SPACE_RE2 + "]+', ' ', 'g')))) AS s FROM @"


@query(f"""WITH a AS ({_SENT.replace("@", "documents")}), b AS ({_SENT.replace("@", "benchmark")}) SELECT count(*) AS shared FROM a JOIN b USING (s) WHERE s <> '' AND length(s) >= 20""")
def overlap_exact_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of 20 characters or more that documents and benchmark share."""
    from ..functions.chars import collapse

    def side(name: str, id_: str) -> DataFrame:
        docs = spread_documents(spark, sf_dir, name=name, key=id_)
        return plain.sentences(docs).select(collapse(F.col("text")).alias("s")).filter(F.length("s") >= 20).distinct()

    return side("documents", "doc_id").intersect(side("benchmark", "item_id")).agg(F.count("*").alias("shared"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def overlap_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text whole."""
    docs = spread_documents(spark, sf_dir).select(key().alias("doc"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("passage"), "text")
    return overlap.contained(docs, items).select(F.col("doc").alias("doc_id"), F.col("passage").alias("item_id"))


@query(rf"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[{sql.SPACE_RE2}]+', '\1' || chr(10), 'g'), chr(10) || '+'),
        lambda s: regexp_replace(s, '^[{sql.SPACE_RE2}]+|[{sql.SPACE_RE2}]+$', '', 'g')), lambda s: s <> '' AND NOT starts_with(s, '#')) AS l FROM documents),
    c AS (SELECT doc_id, text, list_transform(l, lambda s: len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'))) AS n FROM p)
    SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words, len(n) AS sentence_n, coalesce(list_max(n), 0) AS max_sentence_words,
    round(coalesce(list_sum(n)::DOUBLE / nullif(len(n), 0), 0), 9) AS mean_sentence_words FROM c""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.readability(spread_documents(spark, sf_dir))
    return out.select(key(), *(F.col(c).cast("long") for c in ("chars", "words", "sentence_n", "max_sentence_words")), F.round("mean_sentence_words", 9).alias("mean_sentence_words"))


_ARMS = "WITH p AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS u, sum(length(text)) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paired arms (a stand-in for runs under two conditions): characters by role."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("chars", F.length("text"))
    return study.paired(turns, ["conv_id"], "role", "chars", "user", "assistant")


@query(f"{_ARMS} SELECT conv_id, u::BIGINT AS user_chars, a::BIGINT AS assistant_chars, (a - u)::BIGINT AS delta, CASE WHEN u IS NULL AND a IS NULL THEN 'both' WHEN u IS NULL THEN 'user' WHEN a IS NULL THEN 'assistant' END AS missing_arm FROM p")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms(spark, sf_dir).select("conv_id", F.col("user").alias("user_chars"), F.col("assistant").alias("assistant_chars"), "delta", "missing_arm")


@query(f"{_ARMS} SELECT count(a - u) AS pairs, round(avg(a - u), 6) AS mean_delta, median(a - u)::DOUBLE AS median_delta, count(*) FILTER (a IS NULL OR u IS NULL) AS incomplete FROM p")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.delta_summary(arms(spark, sf_dir)).withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"{_ARMS} SELECT CASE WHEN a < u THEN 'treatment' WHEN a > u THEN 'control' WHEN a = u THEN 'tie' ELSE 'incomplete' END AS outcome, count(*) AS n FROM p GROUP BY 1")
def win_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.tally(arms(spark, sf_dir))


@query("""WITH c AS (SELECT l_returnflag, l_suppkey, stddev_samp(l_quantity::DOUBLE) / avg(l_quantity::DOUBLE) * 100 AS cv FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
    SELECT l_returnflag, round(avg(cv), 6) AS mean_cv, count(*) AS cells FROM c GROUP BY l_returnflag""")
def intra_task_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("quantity", F.col("l_quantity").cast("double"))
    return study.variation(runs, ["l_suppkey"], "l_returnflag", "quantity").withColumn("mean_cv", F.round("mean_cv", 6))


@query("SELECT source, lang, median(n_chars)::DOUBLE AS median_chars, count(*) AS n FROM documents GROUP BY ALL")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "lang").agg(F.median("n_chars").alias("median_chars"), F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT lang, n_chars, len(regexp_extract_all(text, '[.!?]')) AS stops FROM documents),
    r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY stops) + (count(*) OVER (PARTITION BY lang, stops) - 1) / 2.0 AS b FROM d)
    SELECT lang, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 3) END AS rho, count(*) AS n FROM r GROUP BY lang""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "n_chars", F.regexp_count("text", F.lit("[.!?]")).alias("stops"))
    return study.spearman(docs, "n_chars", "stops", ["lang"])


_SCORES = """s AS (SELECT doc_id, (doc_id % 3)::INT AS c1, (n_chars % 3)::INT AS c2, ((doc_id + n_chars) % 3)::INT AS c3, ((doc_id // 3) % 3)::INT AS c4, doc_id % 11 = 0 AS blocked FROM documents),
    r AS (SELECT *, c1 + c2 + c3 + c4 AS s, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT + (c4 = 0)::INT AS zeros FROM s)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric scores derived from ids and lengths (there are no reviews in the tables)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = {"c1": F.col("doc_id") % 3, "c2": F.col("n_chars") % 3, "c3": (F.col("doc_id") + F.col("n_chars")) % 3, "c4": F.floor(F.col("doc_id") / 3) % 3}
    return study.rubric(d.select("doc_id", *(v.cast("int").alias(k) for k, v in c.items()), (F.col("doc_id") % 11 == 0).alias("blocked")))


@query(f"""WITH {_SCORES} SELECT doc_id, s::BIGINT AS s, CASE WHEN blocked THEN 'blocked' WHEN s <= 4 OR zeros > 0 THEN 'rejected_major_rework' WHEN s <= 6 THEN 'accepted_minor_rework' ELSE 'accepted' END AS accept_class,
    (CASE WHEN s <= 1 THEN 1 WHEN s <= 3 THEN 2 WHEN s = 4 THEN 3 WHEN s <= 6 THEN 4 ELSE 5 END)::BIGINT AS clarity FROM r""")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.col("s").cast("long"), "accept_class", F.col("clarity").cast("long"))


@query(f"""WITH {_SCORES}, p AS (SELECT a.doc_id, a, b FROM r a JOIN r b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN a.blocked AND NOT b.blocked THEN 'B' WHEN b.blocked AND NOT a.blocked THEN 'A'
    WHEN (a.s, -a.zeros, a.c1, a.c2, a.c4, a.c3) > (b.s, -b.zeros, b.c1, b.c2, b.c4, b.c3) THEN 'A'
    WHEN (a.s, -a.zeros, a.c1, a.c2, a.c4, a.c3) < (b.s, -b.zeros, b.c1, b.c2, b.c4, b.c3) THEN 'B' ELSE 'tie' END AS preferred FROM p""")
def prefer_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(*(F.col(c) for c in (*study.CRITERIA, "s", "blocked")))
    rows = scored(spark, sf_dir).select("doc_id", s.alias("a"))
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return pairs.select("doc_id", study.preference("a", "b").alias("preferred"))


_USAGE = """u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS i, count(*) FILTER (event_type = 'click') AS o, count(*) AS t, max(event_type) FILTER (event_type = 'purchase') AS model FROM events GROUP BY user_id)"""


@query(f"""WITH {_USAGE} SELECT user_id, 'tokens_all_zero' AS code FROM u WHERE i = 0 AND o = 0 AND t = 0 UNION ALL SELECT user_id, 'total_much_greater_than_in_plus_out' FROM u WHERE t > 0 AND i + o > 0 AND t > 3 * (i + o)
    UNION ALL SELECT user_id, 'model_missing_in_usage' FROM u WHERE coalesce(model, '') = ''""")
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage flags, with event counts by user as the usage."""
    e, kind = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type")
    usage = e.groupBy("user_id").agg(F.count_if(kind == "view").alias("input_tokens"), F.count_if(kind == "click").alias("output_tokens"), F.count("*").alias("total_tokens"), F.max(F.when(kind == "purchase", kind)).alias("model"))
    return study.anomalies(usage, "user_id")


@query("""WITH e AS (SELECT doc_id, text, substr(text, 6, 12) AS x FROM documents WHERE length(text) >= 17)
    SELECT doc_id, CASE WHEN (length(text) - length(replace(text, x, ''))) = length(x) THEN position(x IN text) - 1 END::BIGINT AS "offset" FROM e""")
def excerpt_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an excerpt lies, if it lies in one place only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) >= 17")
    return docs.select("doc_id", only_place(F.col("text"), F.substring("text", 6, 12)).cast("long").alias("offset"))


ENTRIES = [("the", "det", "m1", False), ("of", "prep", "m1", False), ("of", "prep", "m2", False), ("thing", "noun", "m1", False), ("Und", "conj", "m1", True), ("que", "pron", "m1", False), ("que", "conj", "m2", False)]
TECHNICAL = ["clown", "la"]


@query(rf"""WITH v(term, pos, meaning, cs) AS (VALUES {", ".join(f"('{t}', '{p}', '{m}', {str(c).lower()})" for t, p, m, c in ENTRIES)}),
    w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word),
    j AS (SELECT word, n, count(term) FILTER (NOT cs OR term = word) AS m FROM w LEFT JOIN v ON lower(term) = lower(word) GROUP BY word, n)
    SELECT word, n, CASE WHEN lower(word) IN ('clown', 'la') THEN 'technical' WHEN m = 0 THEN 'missing' WHEN m = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM j""")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread_documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    entries = vocabulary.table(spark, [dict(zip(vocabulary.FIELDS, e)) for e in ENTRIES])
    return vocabulary.look_up(words, entries, TECHNICAL).select("word", "n", "status")


@query()
def scanner_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review units of all pages, read as Markdown."""
    return scanner.units(table_documents(spark, sf_dir, "pages", "page_id", "html", ".md")).drop("slice_sha256")


@query(f"""WITH {sql.SPANS} SELECT doc_id, count(*) AS findings, min("start") AS first_start FROM spans GROUP BY doc_id""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON reports and read back."""
    found = lint(spread_documents(spark, sf_dir), rules.CATALOG, ["SENT-001"], Context({"text_type": "procedural"}))
    back = read_json_reports(json_reports(found))
    return back.groupBy("uri").agg(F.count("*").alias("findings"), F.min("start").cast("long").alias("first_start")).select(key(), "findings", "first_start")


@query(r"""SELECT page_id AS doc_id, (length(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g')) - length(replace(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), ';', '')))::BIGINT AS semicolons FROM pages""")
def loose_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_documents(spark, sf_dir, "pages", "page_id", "html").select(key(), study.loose_semicolons(F.col("text")).cast("long").alias("semicolons"))


@query(f"""WITH {sql.SPANS}, {sql.UNITS} SELECT lang, round(count(*) FILTER (emitted)::DOUBLE / count(*), 9) AS share FROM units GROUP BY lang""")
def emitted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_units(spark, sf_dir).groupBy("lang").agg(F.round(ratio(F.count_if("emitted"), F.count("*")), 9).alias("share"))


@query("""SELECT doc_id, CASE WHEN position(substr(text, 3, 8) IN text) > 0 AND n2 > 0 THEN (p1 - 1)::BIGINT END AS first_start, CASE WHEN n2 > 0 THEN (p1 + 7 + n2 - 1)::BIGINT END AS second_start
    FROM (SELECT doc_id, text, position(substr(text, 3, 8) IN text) AS p1, position(substr(text, 40, 8) IN substr(text, position(substr(text, 3, 8) IN text) + 8)) AS n2 FROM documents WHERE length(text) >= 60)""")
def ordered_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two fragments of a text lie, each looked for behind the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) >= 60")
    at = records.ordered_places(F.col("text"), F.array(F.substring("text", 3, 8), F.substring("text", 40, 8)))
    return docs.select("doc_id", at[0].cast("long").alias("first_start"), at[1].cast("long").alias("second_start"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS day, true AS valid, false AS broken_valid FROM lineitem""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as text, and with a month that is none."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    broken = F.concat(F.substring("day", 1, 5), F.lit("13"), F.substring("day", 8, 3))
    return rows.select("l_orderkey", "l_linenumber", "day", records.is_iso_date(F.col("day")).alias("valid"), records.is_iso_date(broken).alias("broken_valid"))


@query("""WITH f AS (SELECT conv_id, turn, role, text, CASE turn % 4 WHEN 0 THEN substr(text, 2, 20) WHEN 1 THEN substr(text, 2, 20) || '#' WHEN 2 THEN '  ' ELSE substr(text, 5, 9) END AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'category' WHEN trim(regexp_replace(x, '\\s+', ' ', 'g')) = '' THEN 'empty_excerpt' WHEN NOT contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(x, '\\s+', ' ', 'g'))) THEN 'not_verbatim' END AS reason FROM f""".replace("\\\\s", f"[{sql.SPACE_RE2}]"))
def excerpt_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts held against the text they were taken from (turns of conversations, some of them spoilt)."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k, cut = F.col("turn") % 4, F.substring("text", 2, 20)
    x = F.when(k == 0, cut).when(k == 1, F.concat(cut, F.lit("#"))).when(k == 2, "  ").otherwise(F.substring("text", 5, 9))
    found = t.select(F.concat_ws("/", "conv_id", "turn").alias("case"), "conv_id", "turn", "text", F.col("role").alias("category"), F.lit("minor").alias("severity"), x.alias("excerpt"), F.col("turn").alias("seq"))
    return records.verified(found, ["user", "assistant"], ["minor"]).select("conv_id", "turn", "reason")


@query(r"""SELECT page_id AS doc_id, CASE WHEN regexp_matches(replace(html, chr(13) || chr(10), ''), '\r') THEN 'lone_cr' WHEN regexp_matches(html, '[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') THEN 'separator' END AS fault FROM pages""")
def newline_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_documents(spark, sf_dir, "pages", "page_id", "html").select(key(), records.newline_fault(F.col("text")).alias("fault"))
