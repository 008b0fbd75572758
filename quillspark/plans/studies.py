"""Registered queries of records, reviews' formats, holdout packets and study statistics, over rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions.chars import SPACE_RE2
from ..functions.place import window_around
from ..operators import holdout, metrics, overlap, plain, study
from ..operators.markdown import lintable_text, with_regions
from . import sqlparts as sql
from .evidence import MD_LINES, MARKED_SQL, SEMI_MARKS, SEMI_SQL, TAILS, cleaned, pick, pick_sql, read, replaced
from .queries import key, labelled_units, spread_documents
from .registry import query

#: What the marks of ``evidence.SEMI_MARKS`` leave without their markup.
LEFT = ((" `the;` ", "  "), (" [and;](u;) ", " and; "), (" &amp; ", "  "), (' <b a=";">is;</b> ', " is; "), (" ![x;](y) ", "  "))
LEFT_SQL = "line"
for _old, _new in LEFT:
    LEFT_SQL = f"replace({LEFT_SQL}, '{_old}', '{_new}')"


@query(f"""WITH {MD_LINES.replace(MARKED_SQL, SEMI_SQL)} SELECT doc_id, md5(string_agg(CASE WHEN kind IN ('fence', 'heading') OR loose <= kk THEN '' ELSE {LEFT_SQL} || CASE WHEN kk < n THEN chr(10) ELSE '' END END, '' ORDER BY k)) AS visible_md5 FROM kinds_ GROUP BY doc_id""")
def markdown_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no markup covers in documents marked up and read as Markdown: headings, fences, code, links, images, tags, entities."""
    text = replaced(cleaned(), [("\nThe ", "\n# The; "), *((a, b) for a, b, _ in SEMI_MARKS)])
    tails = F.array(*(F.lit(t) for t in TAILS))
    docs = spread_documents(spark, sf_dir, suffix=".md").select("uri", F.concat(text, F.get(tails, (key() % 3).cast("int"))).alias("text"))
    return with_regions(docs.filter("text <> ''")).select(key(), F.md5(lintable_text()).alias("visible_md5"))


@query(r"""WITH a AS (SELECT doc_id, ['{"b": {"c": ' || n_chars || '}}', 'none', 'x {"a": 1} y {"b": 2} z', '{"a": ', '```json' || chr(10) || '{"n": ' || doc_id || '}' || chr(10) || '```'][(doc_id % 5 + 1)::INT] AS t, doc_id % 5 AS k, n_chars FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN t WHEN 2 THEN '{"a": 1} y {"b": 2}' WHEN 4 THEN '{"n": ' || doc_id || '}' ELSE '' END AS greedy, CASE k WHEN 0 THEN t WHEN 2 THEN '{"b": 2}' WHEN 4 THEN '{"n": ' || doc_id || '}' END AS balanced FROM a""")
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, one a document: the widest braces, and the last object that parses."""
    d, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    forms = F.array(F.concat(F.lit('{"b": {"c": '), n, F.lit("}}")), F.lit("none"), F.lit('x {"a": 1} y {"b": 2} z'), F.lit('{"a": '), F.concat(F.lit('```json\n{"n": '), d, F.lit("}\n```")))
    answers = read(spark, sf_dir, "documents").select("doc_id", F.get(forms, (F.col("doc_id") % 5).cast("int")).alias("t"))
    return answers.select("doc_id", records.greedy_object(F.col("t")).alias("greedy"), records.balanced_object("t").alias("balanced"))


@query("""SELECT doc_id, least(greatest(n_chars % 9 - 1, 1), 5) AS clarity, CASE WHEN doc_id % 3 = 0 THEN 'accepted' ELSE 'rejected_major_rework' END AS accept_class, md5(left(coalesce(text, ''), 240)) AS notes_md5 FROM documents""")
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of reviewers, one a document, brought to their ranges."""
    d = read(spark, sf_dir, "documents")
    rows = d.select("doc_id", (F.col("n_chars") % 9 - 1).alias("clarity"), pick(["accepted", "odd", None], F.col("doc_id") % 3).alias("accept_class"), F.coalesce("text", F.lit("")).alias("notes"))
    return records.normal_score(rows, ["accepted"], "rejected_major_rework").select("doc_id", F.col("clarity").cast("long").alias("clarity"), "accept_class", F.md5("notes").alias("notes_md5"))


@query("""WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS i1, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey * 2 END AS i2, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END AS o1, CASE WHEN o_orderkey % 3 = 1 THEN 5 END AS o2, CASE WHEN o_orderkey % 5 = 0 THEN 99 END AS t FROM orders)
    SELECT k, coalesce(i1, i2, 0) AS input_tokens, coalesce(o1, o2, 0)::BIGINT AS output_tokens, coalesce(t, coalesce(i1, i2, 0) + coalesce(o1, o2, 0))::BIGINT AS total_tokens FROM u""")
def normal_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as usage records under either naming."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 2 == 0, c).alias("input_tokens"), F.when(k % 2 == 1, c * 2).alias("prompt_tokens"), F.when(k % 3 == 0, c % 7).alias("output_tokens"), F.when(k % 3 == 1, F.lit(5).cast("long")).alias("completion_tokens"), F.when(k % 5 == 0, F.lit(99).cast("long")).alias("total_tokens")
    )
    return study.normal_usage(rows).select("k", "input_tokens", "output_tokens", "total_tokens")


@query("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50), w AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT count(*) AS wanted, count(*) FILTER ((user_id, event_type) IN (SELECT (user_id, event_type) FROM k)) AS kept FROM w""")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of runs by user and kind: how many keys are done, and how many there are in all."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") > 50).alias("valid"))
    keys = ["user_id", "event_type"]
    kept, missing = records.resumed(e, e.select(*keys).distinct(), keys)
    both = kept.select(F.lit(1).alias("kept")).unionByName(missing.select(F.lit(0).alias("kept")))
    return both.agg(F.count("*").alias("wanted"), F.count_if(F.col("kept") == 1).alias("kept"))


@query("""SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 17 = 0)""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sent out as rows of a packet and returned: rows whose fixed fields changed, that are lost, or that are new."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.col("o_custkey").alias("b"), F.lit("").alias("decision"))
    returned = o.filter(F.col("k") % 13 != 0).withColumn("b", F.when(F.col("k") % 11 == 0, F.col("b") + 1).otherwise(F.col("b"))).withColumn("a", F.when(F.col("k") % 17 == 0, "?").otherwise(F.col("a"))).withColumn("decision", F.lit("x"))
    return holdout.changed_fields(o, returned, "k", ["a", "b"]).distinct()


@query("""SELECT o_custkey AS case_id, bool_and(o_orderkey % 10 <> 0) AND count(DISTINCT o_orderpriority) = 5 AS approved FROM orders GROUP BY o_custkey""")
def unanimous_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as votes of a panel (by priority) on cases (customers)."""
    votes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("provider"), F.when(F.col("o_orderkey") % 10 != 0, "approve").otherwise("change_required").alias("decision"))
    return study.unanimous(votes, "case_id", 5)


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) SELECT c_custkey, CASE WHEN n % 2 = 1 THEN 'A' ELSE 'B' END AS control_side FROM r""")
def alternating_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases whose control run is shown on either side in turn."""
    return records.alternating(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""SELECT 'case-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS case_id, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n FROM customer)""")
def numbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases with numbers in a global order."""
    return holdout.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"], "case").select("case_id", "c_custkey")


@query(f"""WITH cut AS (SELECT page_id, html, unnest(l) AS piece, generate_subscripts(l, 1) AS k, len(l) AS n FROM (SELECT page_id, html, string_split(html, ';') AS l FROM pages)),
    found AS (SELECT page_id, html, k, (sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS off, n FROM cut),
    placed AS (SELECT page_id, k, string_split(html, chr(10)) AS ls, {sql.place("html", "off")} FROM found WHERE k < n),
    shown AS (SELECT page_id, k, array_to_string(ls[greatest(line - 2, 1):least(line + 2, len(ls))], chr(10)) AS c FROM placed)
    SELECT page_id, k::BIGINT AS ordinal, sha256(c) AS context_sha256, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || left(c, 20) ELSE left(c, 20) END AS begins FROM shown""")
def review_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons of all pages with the lines around them, safe for a spreadsheet, and their digests."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("uri"), F.col("html").alias("text"))
    rows = holdout.review_packet(holdout.occurrences(pages), pages)
    quoted = F.substring("context", 1, 1) == "'"
    begins = F.when(quoted & F.rlike("context", F.lit(r"^'[=+\-@\t\r]")), F.substring("context", 1, 21)).otherwise(F.substring("context", 1, 20))
    return rows.select(F.col("uri").cast("long").alias("page_id"), F.col("ordinal").cast("long"), "context_sha256", begins.alias("begins"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, md5(array_to_string(ls[greatest(len(ls) // 2 - 1, 1):least(len(ls) // 2 + 3, len(ls))], chr(10))) AS window_md5 FROM l""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines on either side of the middle line of each document."""
    docs = read(spark, sf_dir, "documents")
    middle = F.floor(F.size(F.split("text", "\n")) / 2).cast("int") + 1
    return docs.select("doc_id", F.md5(window_around(F.col("text"), middle, 2)).alias("window_md5"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+')) AS runs FROM documents")
def letter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", plain.letter_runs(F.col("text")).cast("long").alias("runs"))


_BASE = f"lower(nfc_normalize(trim(regexp_replace(s, '[{SPACE_RE2}]+', ' ', 'g'))))"


@query(f"""WITH a AS (SELECT DISTINCT left(c_name, 12) AS s FROM customer UNION SELECT '  ' || upper(left(c_name, 12)) || ' x' FROM customer), b AS (SELECT DISTINCT lower(left(c_name, 12)) AS s FROM customer WHERE c_custkey % 2 = 0 UNION SELECT left(c_name, 12) || '  X' FROM customer),
    f AS (SELECT 'exact' AS form, s AS v FROM a UNION SELECT 'collapsed', {_BASE} FROM a UNION SELECT 'squeezed', replace({_BASE}, ' ', '') FROM a), g AS (SELECT 'exact' AS form, s AS v FROM b UNION SELECT 'collapsed', {_BASE} FROM b UNION SELECT 'squeezed', replace({_BASE}, ' ', '') FROM b),
    j AS (SELECT f.form, count(*) AS n FROM f JOIN g ON f.form = g.form AND f.v = g.v GROUP BY 1) SELECT x.form, coalesce(n, 0) AS n FROM (VALUES ('exact'), ('collapsed'), ('squeezed')) x(form) LEFT JOIN j ON j.form = x.form""")
def overlap_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two lists of customers share, as they are and under both normalisations."""
    c = read(spark, sf_dir, "customer")
    name = F.left("c_name", F.lit(12))
    a = c.select(name.alias("text")).unionByName(c.select(F.concat(F.lit("  "), F.upper(name), F.lit(" x")).alias("text")))
    b = c.filter("c_custkey % 2 = 0").select(F.lower(name).alias("text")).unionByName(c.select(F.concat(name, F.lit("  X")).alias("text")))
    return overlap.shared(a, b)


@query(rf"""WITH {sql.SPANS}, {sql.UNITS}, m AS (SELECT source, {sql.HOLDOUT} FROM units GROUP BY source), w AS (SELECT source, sum(len(regexp_extract_all(text, '\p{{L}}+')))::BIGINT AS words FROM documents GROUP BY source)
    SELECT source, round(1000 * fp::DOUBLE / nullif(words, 0), 9) AS fp_per_1000_words, coalesce(tp::DOUBLE / nullif(tp + fp, 0) >= 0.1, false) AND coalesce(tp::DOUBLE / nullif(tp + fn, 0) >= 0.01, false) AS passed FROM m JOIN w USING (source)""")
def gates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives a thousand words, and whether each source passes a gate of precision and recall."""
    words = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(plain.letter_runs(F.col("text"))).alias("words"))
    found = metrics.with_metrics(metrics.confusion(labelled_units(spark, sf_dir), ["source"], "holdout").join(words, "source"), words="words")
    return metrics.gate(found, {"precision": 0.1, "recall": 0.01}).select("source", F.round("fp_per_1000_words", 9).alias("fp_per_1000_words"), "passed")


@query("""WITH m AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT k FROM m WHERE k % 7 = 0 OR k % 10 = 3""")
def metrics_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two computations of the same sums by supplier, one of them changed for some and without others."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    other = m.filter("k % 10 <> 3").withColumn("q", F.when(F.col("k") % 7 == 0, F.col("q") + 0.5).otherwise(F.col("q")))
    return metrics.agree(m, other, ["k"], ["n", "q"])


@query(f"""WITH u AS (SELECT doc_id AS uri, n_chars AS start FROM documents), s AS (SELECT doc_id AS uri, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS start FROM documents UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 8 = 0)
    SELECT uri % 3 AS part, count(*) AS strays FROM s WHERE (uri, start) NOT IN (SELECT (uri, start) FROM u) GROUP BY 1""")
def stray_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, some reported twice, that belong to no unit."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.col("n_chars").alias("start"))
    off = d.withColumn("start", F.col("start") + F.when(F.col("uri") % 4 == 0, 1).otherwise(0))
    again = d.filter("uri % 8 = 0").withColumn("start", F.col("start") + 1)
    return metrics.unmatched(off.unionByName(again), d, ["uri", "start"]).groupBy((F.col("uri") % 3).alias("part")).agg(F.count("*").alias("strays"))


USAGE_FIELDS = ["clarity", "major", "x"]


@query(f"""WITH f AS (SELECT doc_id, text, {pick_sql(USAGE_FIELDS, "doc_id % 3")} AS category, CASE WHEN n_chars % 2 = 0 THEN 'major' ELSE 'huge' END AS severity, CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 5 = 1 THEN 'qqqqzz' ELSE left(text, 15) END AS excerpt FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, CASE WHEN category <> 'clarity' THEN 'category' WHEN severity <> 'major' THEN 'severity' WHEN regexp_matches(excerpt, '^[{SPACE_RE2}]*$') THEN 'empty_excerpt' WHEN excerpt = 'qqqqzz' THEN 'not_verbatim' END AS reason FROM f)
    SELECT reason, count(*) AS n FROM (SELECT reason FROM g UNION ALL SELECT coalesce(reason, 'duplicate') FROM g) GROUP BY reason""")
def findings_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on all documents, each reported twice: why they are rejected, if they are."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    excerpt = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 1, "qqqqzz").otherwise(F.left("text", F.lit(15)))
    one = d.select(F.col("doc_id").alias("case"), "text", pick(USAGE_FIELDS, F.col("doc_id") % 3).alias("category"), F.when(F.col("n_chars") % 2 == 0, "major").otherwise("huge").alias("severity"), excerpt.alias("excerpt"))
    both = one.withColumn("seq", F.lit(0)).unionByName(one.withColumn("seq", F.lit(1)))
    return records.verified(both, ["clarity"], ["major"]).groupBy("reason").agg(F.count("*").alias("n"))
