"""Language decisions, projections, inventories, offset cases and reviews on small tables whose results are known."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.place import region_at
from quillspark.plans import evidence as _  # noqa: F401
from quillspark.plans import queries
from quillspark.operators import contracts, intake, inventory, language, offsets, plain, projection, review, rules, vocabulary
from quillspark.operators.catalog import Context, lint
from quillspark.operators.markdown import mask

DOC = "uri string, text string"


# --- language ------------------------------------------------------------------------------------------------------------------------

#: Sentences as (word, part of speech, tag, dependency, head).
AGENT = "The/DET/DT/det/1 guard/NOUN/NN/nsubjpass/3 is/AUX/VBZ/auxpass/3 lifted/VERB/VBN/ROOT/3 by/ADP/IN/agent/3 hand/NOUN/NN/pobj/4 ./PUNCT/./punct/3"
MODAL = "Oil/NOUN/NN/nsubjpass/3 must/AUX/MD/aux/3 be/AUX/VB/auxpass/3 drained/VERB/VBN/ROOT/3 ./PUNCT/./punct/3"
BARE = "The/DET/DT/det/1 lid/NOUN/NN/nsubjpass/3 is/AUX/VBZ/auxpass/3 shut/VERB/VBN/ROOT/3 ./PUNCT/./punct/3"
STATE = BARE.replace("shut/VERB", "shut/ADJ")
ORDER = "Close/VERB/VB/ROOT/0 the/DET/DT/det/2 lid/NOUN/NN/dobj/0 ./PUNCT/./punct/0"
TELLS = "They/PRON/PRP/nsubj/1 close/VERB/VBP/ROOT/1 it/PRON/PRP/dobj/1 ./PUNCT/./punct/1"
THING = "A/DET/DT/det/1 lid/NOUN/NN/ROOT/1 ./PUNCT/./punct/1"
TWO = "Go/VERB/VB/ROOT/0 stop/VERB/VB/ROOT/1 ./PUNCT/./punct/1"


@pytest.fixture(scope="module")
def decide(spark):
    def run(*cases):
        """Decisions of (parse, text type, complete, parts) by rule."""
        sentences, parses = [], []
        for n, (parse, text_type, complete, parts) in enumerate(cases):
            tokens = [x.rsplit("/", 4) for x in (parse or "x/X/X/ROOT/0").split(" ")]
            at = 0
            for i, (word, pos, tag, dep, head) in enumerate(tokens):
                if parse:
                    parses.append(("a", n, i, int(head), pos, tag, dep, at, at + len(word)))
                at += len(word) + 1
            sentences.append(("a", n, 100 * n, 100 * n + at, complete, parts, text_type))
        s = spark.createDataFrame(sentences, "uri string, sentence int, start int, end int, complete boolean, parts int, text_type string")
        p = spark.createDataFrame(parses, "uri string, sentence int, i int, head int, pos string, tag string, dep string, start int, end int")
        rows = language.evaluated(s, p)
        return {(r.rule_id, r.sentence): (r.decision, r.reason, [tuple(x) for x in r.findings]) for r in rows.collect()}, rows, s, p

    return run


def test_voice_decisions(decide):
    got, rows, *_ = decide(
        (AGENT, "procedural", True, 1), (AGENT, "descriptive", True, 1), (AGENT, "procedural-note", True, 1), (MODAL, "procedural", True, 1), (MODAL, "descriptive", True, 1), (BARE, "procedural", True, 1),
        (STATE, "descriptive", True, 1), (BARE, "procedural", False, 1), (AGENT, "procedural", True, 2), (None, "procedural", True, 1), (AGENT, None, True, 1), (AGENT, "poem", True, 1), (ORDER, "procedural", True, 1),
    )
    want = [("emit", "", [(13, 19)]), ("emit", "", [(113, 119)]), ("emit", "", [(213, 219)]), ("emit", "", [(312, 319)]), ("abstain", "unconfirmed", []), ("abstain", "unconfirmed", []), ("clear", "", []), ("abstain", "incomplete", [])]
    want += [("abstain", "several_parts", []), ("abstain", "no_parse", []), ("abstain", "undeclared", []), ("abstain", "undeclared", []), ("clear", "", [])]
    assert [got[language.VOICE, n] for n in range(len(want))] == want
    counts = {(r.rule_id, r.decision, r.reason): r.sentences for r in language.histogram(rows).collect()}
    assert counts[language.VOICE, "abstain", "unconfirmed"] == 2 and counts[language.VOICE, "emit", ""] == 4 and sum(counts.values()) == 26


def test_note_decisions(decide):
    note = "procedural-note"
    got, *_ = decide((ORDER, note, True, 1), (ORDER, "procedural", True, 1), (TELLS, note, True, 1), (THING, note, True, 1), (TWO, note, True, 1), (TELLS.replace("VBP", "VBD"), note, True, 1), (ORDER, note, False, 1), (None, note, True, 1))
    want = [("emit", "", [(0, 5)]), ("clear", "not_a_note", []), ("abstain", "subject", []), ("abstain", "no_verb", []), ("abstain", "roots", []), ("clear", "", []), ("abstain", "incomplete", []), ("abstain", "no_parse", [])]
    assert [got[language.NOTE, n] for n in range(len(want))] == want


def test_only_what_is_emitted_is_reported(spark, decide):
    _, _, s, p = decide((AGENT, "procedural", True, 1), (BARE, "procedural", True, 1), (ORDER, "procedural-note", True, 1))
    docs = spark.createDataFrame([("a.txt", "z" * 300)], DOC)
    named = [df.withColumn("uri", F.lit("a.txt")) for df in (s, p)]
    context = Context(tables={"sentences": named[0], "parses": named[1]})
    got = sorted((r.rule_id, r.start, r.end, r.evidence) for r in lint(docs, rules.CATALOG, ["PASV-001", "NOTE-001"], context).collect())
    assert got == [("NOTE-001", 200, 205, "z" * 5), ("PASV-001", 13, 19, "z" * 6)]
    with pytest.raises(Exception, match="parse of another text"):
        language.evaluated(s.withColumn("end", F.col("start") + 3), p).collect()


def test_parsers_that_run_over_documents_decide_as_token_rows_do(spark, decide):
    cases = [(p, t, c, n) for p in (AGENT, MODAL, BARE, STATE, ORDER, TELLS, THING, TWO, f"{AGENT} {ORDER}", None) for t in ("procedural", "descriptive", "procedural-note", None) for c, n in ((True, 1), (False, 1), (True, 2))]
    _, rows, s, p = decide(*cases)
    tokens = {}
    for r in p.collect():
        tokens.setdefault(r.sentence, []).append(language.Token(r.i, r.head, r.pos, r.tag, r.dep, r.start, r.end))
    given = [(tuple(r)[1:], tokens.get(r.sentence, [])) for r in s.collect()]
    docs = spark.createDataFrame([("a", "")], DOC)
    got = language.decisions(language.parsed(docs, "sentence int, start int, end int, complete boolean, parts int, text_type string", lambda doc: iter(given)))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and got.count() == 2 * len(cases)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


# --- projection ----------------------------------------------------------------------------------------------------------------------


def shown(text):
    """The projection of a whole text, from its lines."""
    out = list(text)
    for x in projection.projected_lines(text):
        out[x["start"] : x["end"]] = x["shown"]
    return "".join(out)


@pytest.mark.parametrize(
    "text, want, doubt",
    [
        ("# Head\ntext", "      \ntext", []),
        ("Head\n====\ntext", "    \n    \ntext", []),
        ("a `b;c` d", "a       d", []),
        ("a `b;c d", "a `b;c d", [0]),
        ("```\nx;\n```\ny", "   \n  \n   \ny", []),
        ("```\nx;\ny", "   \nx;\ny", [0, 1, 2]),
        ("a\n```\nx\n~~~\ny\n~~~", "a\n   \nx\n   \n \n   ", [1, 2, 3, 4, 5]),
        ("a\n<!-- b\nc --> d\ne", "a\n      \n       \ne", []),
        ("a\n<!-- b\n# c", "a\n<!-- b\n# c", [1, 2]),
        ("---\na: b\n---\nc", "   \n    \n   \nc", []),
        ("---\na: b\nc", "---\na: b\nc", [0, 1, 2]),
        ("- item [l](u) ![i](u)", "  item  l            ", []),
        ("> quote &amp; <b>x</b>", "  quote          x    ", []),
        ("{{< note >}}\na {{< b >}} c", "            \na           c", []),
        ("a {{< b c", "a {{< b c", [0]),
        ("h | i\n--- | ---\n1 | 2\nz", "     \n         \n     \nz", []),
        ("[a]: http://x\nb <http://y>", "             \nb           ", []),
        ("a\r\n# b\r\nc", "a\r\n   \r\nc", []),
        ("    code\n\ttab\nx", "        \n    \nx", []),
        ("***\nx", "   \nx", []),
        ("", "", []),
    ],
)
def test_projection(text, want, doubt):
    assert shown(text) == want and len(shown(text)) == len(text)
    assert [x["k"] for x in projection.projected_lines(text) if x["uncertain"]] == doubt


def test_projection_keeps_lengths_of_any_text():
    rng = random.Random(5)
    parts = ["`", "```\n", "~~~~\n", "<!--", "-->", "---\n", "{{<", ">}}", "[a](b)", "![", "<b>", "&amp;", "- ", "1. ", "> ", "# ", "\n", "\r\n", "    ", "|", "word ", "x; ", "==="]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        out = shown(text)
        assert len(out) == len(text) and [c for c in out if c in "\r\n"] == [c for c in text if c in "\r\n"]
        assert all(a in (b, " ") for a, b in zip(out, text))


def test_many_open_marks_take_linear_time():
    import time

    began = time.perf_counter()
    for mark in ("```\n~~~~\n", "<!--\n"):
        projection.projected_lines(mark * 60_000)
    assert time.perf_counter() - began < 20


def test_other_line_ends_are_left_alone(spark):
    df = spark.createDataFrame([("a", "x\ry; `z`"), ("b", "p\x85q"), ("c", None)], DOC)
    assert [(r.uri, r.kind, r.uncertain, r.shown) for r in projection.lines(df).orderBy("uri").collect()] == [("a", "separator", True, "x\ry; `z`"), ("b", "separator", True, "p\x85q")]


def lists(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOC)
    return {(r.uri, r.start): r for r in projection.list_units(projection.lines(df)).collect()}


def test_list_units_and_their_lead_ins(spark):
    texts = (
        "Use these tools.\n\n- hammer\n- saw\n  - fine\n  - coarse\n\nEnd",
        "Lead:\n\n\n- a\n- b",
        "Lead\n# Head\n- a\n- b",
        "Lead\n\n> quote\n\n- a\n- b",
        "Lead\n***\n```\nx\n```\n- a\n- b",
        "- a\n- b",
        "Lead `x.\n- a\n- b `y",
        "Lead.\n\n- a\n1. b\n2. c\n- d\n  more\nnext\n- e\n- f",
    )
    got = lists(spark, *texts)
    r = got["0", 18]
    assert (r.end, r.peers, r.lead_in_status, r.lead_in_start, r.lead_in_end, r.blank_lines, r.list_terminal, r.blockers, r.uncertain) == (texts[0].index("\n\nEnd"), 2, "found", 0, 16, 1, "period", [], False)
    nested = got["0", texts[0].index("  - fine")]
    assert (nested.indentation, nested.peers, texts[0][nested.lead_in_start : nested.lead_in_end], nested.list_terminal) == (2, 2, "saw", "other")
    assert (got["1", 8].blank_lines, got["1", 8].list_terminal, got["1", 8].blockers) == (2, "colon", ["more_than_one_blank_line"])
    assert got["2", 12].blockers == ["heading"] and got["2", 12].lead_in_end == 4
    assert got["3", 15].blockers == [] and texts[3][got["3", 15].lead_in_start : got["3", 15].lead_in_end] == "quote"
    assert got["4", 19].blockers == ["fence", "thematic_break"]
    r = got["5", 0]
    assert (r.lead_in_status, r.lead_in_start, r.lead_in_end, r.blank_lines, r.list_terminal) == ("not_found", -1, -1, -1, "absent")
    assert (got["6", 9].lead_in_status, got["6", 9].uncertain) == ("uncertain", True)
    assert {(r.start, r.family, r.peers) for (u, _), r in got.items() if u == "7"} == {(texts[7].index("1. b"), "ordered", 2), (texts[7].index("- e"), "bullet", 2)}


def test_blocks_follow_items_and_quotes(spark):
    text = "- item\n  goes on\nprose now\n  still prose\n> q1\n> q2\nafter\n\n***\n- !\n- x"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], DOC)
    rows = projection.blocks(projection.lines(df)).orderBy("first_line").collect()
    assert [(r.kind, r.first_line, r.last_line) for r in rows] == [("list", 0, 1), ("prose", 2, 3), ("quote", 4, 5), ("prose", 6, 6), ("list", 10, 10)]


def test_prose_of_any_depth_ends_lists_where_items_do_not_go_on(spark):
    text = "Lead.\n- a\n- b\n own line.\n- c\n- d"
    df = spark.createDataFrame([("a", text)], DOC)
    units = lambda **how: [(r.start, r.peers, text[r.lead_in_start : r.lead_in_end]) for r in projection.list_units(projection.lines(df, **how), **how).orderBy("start").collect()]
    assert units() == [(6, 4, "Lead.")]
    assert units(hanging=False) == [(6, 2, "Lead."), (text.index("- c"), 2, "own line.")]


def test_list_runs_found_in_a_walk_are_those_of_line_rows(spark):
    rng = random.Random(11)
    parts = ["`", "```\n", "~~~\n", "***\n", "# H\n", "{{<", "[a](b)", "&amp;", "- ", "- a\n", "  - b\n", "1. c\n", "> q\n", ">\n", "\n", "\n", "\r\n", "  ", "\u00a0", "word.", "Use these tools:\n", " deep\n", "x; ", "é!\n", "---\n", "\n-  \u2003!\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a\x85- b", "- a\r\n- b\r\n"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], DOC)
    for hanging in (True, False):
        ls = projection.lines(df, hanging)
        found = projection.found_list_units(df, hanging)
        want = projection.list_units(ls, hanging)
        assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
        assert all(r.lead_in == (texts[int(r.uri)][r.lead_in_start : r.lead_in_end] if r.lead_in_start >= 0 else "") for r in found.collect())
        columns = ("first_line", "last_line", "kind", "start", "end", "uncertain", "shown_start", "shown_end", "terminal")
        blocks = [(str(k), *(b[c] for c in columns), " ".join(b["body"])) for k, t in enumerate(texts) for b in projection.text_blocks(projection.projected_lines(t or "", hanging), hanging)]
        assert sorted(blocks) == sorted(map(tuple, projection.blocks(ls, with_body=True, hanging=hanging).select("uri", *columns, "body").collect()))
        for df_ in (found, projection.scan_counts(df, hanging)):
            assert "Exchange" not in df_._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["list_lead_ins", "list_label_counts", "scan_counts"])
def test_list_queries_join_no_text(spark, tmp_path, name):
    spark.createDataFrame([(0, "Aa. Bb, cc. Dd."), (1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["list_lead_ins", "list_label_counts", "scan_counts"])
def test_lists_with_indented_prose_agree_with_their_sql(spark, tmp_path, name):
    import duckdb

    texts = ["Yes. Aa bb\n cc. Dd, ee, ff. Gg", "Aa. Bb. The\n dogs. Cc. Dd.\n Ee, ff, gg. Hh and it ii. Jj", "  Aa. Bb. Cc", *([] if name == "scan_counts" else [None]), ""]  # of a null text, scan_counts has 0 semicolons and its SQL null
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(at)
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


# --- error rows ----------------------------------------------------------------------------------------------------------------------


def test_what_cannot_be_read_is_told_and_the_rest_is_linted(spark):
    long = "word " * 21 + "end."
    rows = [("a.txt", long), ("b.md", "x " * 600_000), ("c.pdf", long), ("d.TXT", "y" * 1_000_000), ("e.txt", None), (None, long), ("f.Markdown", long)]
    docs = spark.createDataFrame(rows, DOC)
    assert {(r.uri, r.code) for r in intake.problems(docs).collect()} == {("b.md", "too_long"), ("c.pdf", "unsupported_format"), (None, "unsupported_format")}
    for rule in ("SENT-001", "SEMI-001", "LIST-001"):
        got = {r.uri for r in lint(docs, rules.CATALOG, [rule], Context({"text_type": "procedural"})).collect()}
        assert got == ({"a.txt", "f.Markdown"} if rule == "SENT-001" else set())
    with pytest.raises(Exception, match="over 1000000 code points"):
        plain.sentences(docs).collect()
    with pytest.raises(Exception, match="unsupported suffix"):
        rules.semicolons(docs.filter("uri = 'c.pdf'"), Context()).collect()
    assert [intake.exit_code(*x) for x in ((0, 0), (3, 0), (0, 1), (3, 1), (0, 0, 1))] == [0, 1, 2, 2, 1]


def test_findings_bring_their_places_and_context(spark):
    long = "word " * 21 + "end."
    docs = spark.createDataFrame([("a.txt", f"x y\n  pre. {long} post. z\nlast"), ("b.md", f"# h\n\npre. {long} post.")], DOC)
    got = {r.uri: r for r in lint(docs, rules.CATALOG, ["SENT-001"], Context({"text_type": "procedural"}), with_context=True).collect()}
    a, b = got["a.txt"], got["b.md"]
    assert (a.start_line, a.start_column, a.span, a.context) == (2, 8, long, f"  pre. {long} post. z")
    assert (b.start_line, b.start_column, b.span, b.context) == (3, 6, long, f"pre. {long} post.")


def test_older_profile_is_reached_from_the_rules(spark):
    docs = spark.createDataFrame([("a.md", "a <!-- ; --> $x;$ b; http://x;y")], DOC)
    at = lambda **o: [r.start for r in lint(docs, rules.CATALOG, ["SEMI-001"], Context(o)).orderBy("start").collect()]
    assert at() == [19] and at(markdown_profile="older") == [7, 15, 19, 29]
    assert not mask("b; c")[1]


def test_marks_count_bytes_and_places(spark):
    docs = spark.createDataFrame([("a", "é;\n;中;"), ("b", "")], DOC)
    assert [tuple(r)[1:7] for r in plain.marks(docs, ";").orderBy("ordinal").collect()] == [(1, 1, 2, 2, 1, 2), (2, 3, 4, 4, 2, 1), (3, 5, 6, 8, 2, 3)]


# --- regions, offset cases -----------------------------------------------------------------------------------------------------------


def test_region_lookup(spark):
    regions = [(0, 3), (3, 4), (6, 9)]
    df = spark.createDataFrame([([], 0), *((regions, k) for k in range(-1, 11))], "regions array<struct<start:int,end:int>>, at int")
    got = [r.i for r in df.select(region_at(F.col("regions"), F.col("at")).alias("i")).collect()]
    assert got == [None, None, 0, 0, 0, 1, None, None, 2, 2, 2, None, None]
    rng = random.Random(2)
    edges = sorted(rng.sample(range(10_000), 2000))
    many = list(zip(edges[::2], edges[1::2]))
    want = [next((i for i, (a, b) in enumerate(many) if a <= k < b), None) for k in range(0, 10_000, 37)]
    df = spark.createDataFrame([(many, k) for k in range(0, 10_000, 37)], "regions array<struct<start:int,end:int>>, at int")
    assert [r.i for r in df.select(region_at(F.col("regions"), F.col("at")).alias("i")).collect()] == want


@pytest.fixture(scope="module")
def cases(spark):
    rows = [("1", "A bomba do-it está. `x` Pare já.", ["A bomba do-it está.", "Pare já."]), ("2", "`só código`", []), ("3", "Tudo.", ["Tudo."]), ("4", "", []), ("5", "na na na", ["na", "na"])]
    return spark.createDataFrame(rows, "uri string, text string, fragments array<string>")


def test_offset_cases(spark, cases):
    spans, tokens = offsets.segments(cases), offsets.surface_tokens(cases, ["do-it"])
    words, left = offsets.syntactic_words(tokens, {"na": ["em", "a"]}), offsets.abstentions(cases, spans)
    sentences = offsets.sentence_spans(tokens)
    assert {(r.uri, r.segment, r.start, r.end) for r in spans.collect()} == {("1", 0, 0, 19), ("1", 1, 24, 32), ("3", 0, 0, 5), ("5", 0, 0, 2), ("5", 1, 3, 5)}
    texts = {r.uri: r.text for r in cases.collect()}
    got = tokens.orderBy("uri", "token").collect()
    assert all(texts[r.uri][r.start : r.end] == r.text for r in got)
    assert [r.text for r in got if r.uri == "1"] == ["A", "bomba", "do-it", "está", ".", "Pare", "já", "."]
    assert [(r.token, r.form) for r in words.filter("uri = '5'").orderBy("word").collect()] == [(0, "em"), (0, "a"), (1, "em"), (1, "a")]
    assert {(r.uri, r.start, r.end) for r in left.collect()} == {("1", 19, 24), ("2", 0, 11), ("5", 5, 8)}
    reasons = {r.uri: r.abstention_reason for r in offsets.abstention_reason(cases, spans, left).collect()}
    assert reasons == {"1": "partial-structural-markup", "2": "structural-markup", "3": None, "4": None, "5": "partial-structural-markup"}
    assert offsets.case_faults(cases, spans, tokens, sentences, words, left).count() == 0
    ranges = {(r.uri, r.segment): (r.first_word, r.past_last_word) for r in offsets.word_ranges(sentences, words).collect()}
    assert ranges == {("1", 0): (0, 5), ("1", 1): (5, 8), ("3", 0): (0, 2), ("5", 0): (0, 2), ("5", 1): (2, 4)}


def test_offset_faults_are_found(cases):
    spans, tokens = offsets.segments(cases), offsets.surface_tokens(cases)
    words, left, sentences = offsets.syntactic_words(tokens, {}), offsets.abstentions(cases, spans), offsets.sentence_spans(tokens)
    faults = lambda **k: {(r.uri, r.fault, r.n) for r in offsets.case_faults(cases, **({"spans": spans, "tokens": tokens, "sentences": sentences, "words": words, "left_out": left} | k)).collect()}
    one = F.col("uri") == "1"
    assert faults(spans=spans.withColumn("end", F.when(one & (F.col("segment") == 0), 30).otherwise(F.col("end")))) == {("1", "span_overlap", 1), ("1", "span_crossing", 1)}
    assert faults(spans=spans.withColumn("end", F.when(F.col("uri") == "3", 99).otherwise(F.col("end")))) == {("3", "span_invalid", 1)}
    assert faults(sentences=sentences.withColumn("start", F.when(one & (F.col("segment") == 1), 25).otherwise(F.col("start")))) == {("1", "sentence_edges", 1)}
    assert faults(words=words.withColumn("token", F.when((F.col("uri") == "3") & (F.col("token") == 1), 7).otherwise(F.col("token")))) == {("3", "orphan_word", 1)}
    assert faults(tokens=tokens.withColumn("text", F.when(one & (F.col("token") == 1), "pompa").otherwise(F.col("text")))) == {("1", "token_slice", 1)}
    late = tokens.withColumn("start", F.when(one & (F.col("token") == 1), 1).otherwise(F.col("start"))).withColumn("end", F.when(one & (F.col("token") == 0), 2).otherwise(F.col("end")))
    assert ("1", "token_overlap", 1) in faults(tokens=late)


def test_fragments_out_of_order_fail(spark):
    df = spark.createDataFrame([("1", "a b", ["b", "a"])], "uri string, text string, fragments array<string>")
    with pytest.raises(Exception, match="fragment not found"):
        offsets.segments(df).collect()


def test_freezing_asks_for_unanimity(spark):
    case = spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, n int")
    vote = lambda *rows: spark.createDataFrame(rows, "case_id string, provider string, decision string")
    good = [(c, p, "approve") for c in ("c1", "c2") for p in ("x", "y")]
    panel = {"x": "model-a", "y": "model-b"}
    got = offsets.frozen(case, vote(*good, ("c1", "z", "change_required")), panel, "2026-01-02").collect()
    assert {(r.case_id, r.review_status, r.reviewed_by, r.reviewed_on) for r in got} == {(c, offsets.STATUS_APPROVED, "x:model-a;y:model-b", "2026-01-02") for c in ("c1", "c2")}
    for bad in (good[:3], [*good[:3], ("c2", "y", "change_required")]):
        with pytest.raises(Exception, match="not unanimous: c2"):
            offsets.frozen(case, vote(*bad), panel, "2026-01-02").collect()


# --- inventories ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def units(spark):
    docs = spark.createDataFrame([("a.md", "One; two.\nThree; é"), ("b.md", "Four.")], DOC)
    rows = [("a.md", "s1", "procedural", "SEMI-001", "semicolon", 3, 4, "visible_prose"), ("a.md", "s1", "procedural", "SEMI-001", "semicolon", 15, 16, "visible_prose"), ("b.md", "s2", "descriptive", "SENT-001", "sentence_complete", 0, 5, "visible_prose")]
    frame = spark.createDataFrame(rows, "uri string, source_id string, text_type string, rule_id string, unit_kind string, start int, end int, structural_context string")
    return docs, inventory.records(frame, docs)


def test_records_keep_their_contract(units):
    docs, rows = units
    got = {(r.uri, r.start): r for r in rows.collect()}
    r = got["a.md", 15]
    assert (r.start_line, r.start_column, r.end_line, r.end_column, r.truth) == (2, 6, 2, 7, "pending-review") and len({x.case_id for x in got.values()}) == 3
    faults = lambda df, **k: sorted((r.uri, r.start, tuple(r.faults)) for r in inventory.contract_faults(df, docs, ["SEMI-001", "SENT-001"], **k).collect())
    assert faults(rows) == []
    first = (F.col("uri") == "a.md") & (F.col("start") == 3)
    change = lambda c, v: rows.withColumn(c, F.when(first, v).otherwise(F.col(c)))
    assert faults(change("slice_sha256", "0")) == [("a.md", 3, ("slice",))]
    assert faults(change("start_line", 7)) == [("a.md", 3, ("start_place",))] and faults(change("end_column", 7)) == [("a.md", 3, ("end_place",))]
    assert faults(change("truth", "violation")) == [("a.md", 3, ("state",))] and faults(change("structural_context", "odd")) == [("a.md", 3, ("context",))]
    assert faults(change("end", 99)) == [("a.md", 3, ("case_id", "span"))]
    assert faults(change("uri", "c.md")) == [("c.md", 3, ("case_id", "document"))]
    assert faults(rows.unionByName(rows.filter(first))) == [("a.md", 3, ("duplicate",))] * 2
    assert faults(rows, excluded={"SENT-001": ["b.md"]}) == [("b.md", 0, ("excluded",))]


def test_records_found_and_checked_in_one_walk(spark):
    changes = [
        {}, {"slice_sha256": "x"}, {"start_line": 9}, {"end_column": None}, {"end": 99}, {"start": None}, {"truth": "violation"}, {"review_status": None}, {"rule_id": "ODD"}, {"rule_id": None}, {"structural_context": "odd"},
        {"source_id": None}, {"unit_kind": None}, {"case_id": "same"}, {"case_id": None}, {}, {},
    ]
    docs = spark.createDataFrame([("a.md", "One; two.\nThree; é"), ("b.md", "Four; x"), ("c.md", None), ("d.md", ""), ("e.md", ";\n" * len(changes)), ("f.md", "; ; ;")], DOC)
    own = {"source_id": "s1", "text_type": "procedural", "rule_id": "SEMI-001", "unit_kind": "semicolon", "structural_context": "visible_prose"}
    sound = lambda doc: inventory.made_records(doc["uri"], doc["text"] or "", [{"start": k, "end": k + 1, **own} for k, c in enumerate(doc["text"] or "") if c == ";"])
    told = {"a.md": [{"case_id": "same"}, {"case_id": None}], "b.md": [{"case_id": "same"}], "e.md": changes, "f.md": [{}, {"case_id": "twice"}, {"case_id": "twice"}]}

    def records(doc):
        for n, r in enumerate(sound(doc)):
            yield from [r | told[doc["uri"]][n]] * (2 if (doc["uri"], n) == ("e.md", len(changes) - 1) else 1)

    texts = [d.asDict() for d in docs.collect()]
    units = [r for d in texts for r in sound(d)]
    names = ("uri", "start", "end", *own)
    whole = inventory.records(spark.createDataFrame([tuple(u[c] for c in names) for u in units], ", ".join(f"{c} {'int' if c in ('start', 'end') else 'string'}" for c in names)), docs)
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r[c] for c in whole.columns) for r in units) and len(units) == len(changes) + 6
    rows = spark.createDataFrame([tuple(r[c] for c in whole.columns) for d in texts for r in records(d)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema))
    left_out = {"SEMI-001": ["b.md"]}
    found, want = inventory.found_faults(docs, records, ["SEMI-001"], left_out), inventory.contract_faults(rows, docs, ["SEMI-001"], left_out).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, found.select("uri", "case_id", "start", "end", "faults").collect())) == sorted(key((r.uri, r.case_id, r.start, r.end, r.faults)) for r in want)
    assert {(r.uri, r.start) for r in want if "duplicate" in r.faults} == {("a.md", 3), ("a.md", 15), ("b.md", 4), ("e.md", 26), ("e.md", 28), ("e.md", 32), ("f.md", 2), ("f.md", 4)}
    assert {tuple(r.faults) for r in want if r.uri == "b.md"} == {("case_id", "excluded", "duplicate")} and {c for r in want for c in r.faults} >= {"unknown_rule", "context", "state", "span", "slice", "start_place", "end_place"}
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_digests_do_not_depend_on_how_rows_lie(spark, units):
    _, rows = units
    one = inventory.digests(rows).first()
    assert inventory.digests(rows.repartition(5)).first() == one and inventory.digests(rows.orderBy(F.col("case_id").desc())).first() == one
    assert inventory.digests(rows.unionByName(rows)).first() != one
    swapped = rows.withColumn("text_type", F.when(F.col("uri") == "b.md", "procedural").otherwise(F.col("text_type")))
    assert [r.uri for r in inventory.differing(rows, swapped, ["uri"]).collect()] == ["b.md"]
    assert inventory.differing(rows, rows.repartition(3), ["uri"]).count() == 0
    assert [r.uri for r in inventory.differing(rows, rows.filter("uri = 'a.md'"), ["uri"]).collect()] == ["b.md"]


def test_order_is_checked_across_parts(spark):
    rows = lambda *parts: spark.createDataFrame([(p, i, v) for p, vs in enumerate(parts) for i, v in enumerate(vs)], "part int, place int, v int").repartition(3)
    bad = lambda *parts: sorted((r.part, r.place) for r in inventory.order_faults(rows(*parts), [F.col("v")], "part", "place").collect())
    assert bad([1, 2], [], [2, 3], [4]) == []
    assert bad([1, 3, 2], [2, 3]) == [(0, 2)]
    assert bad([1, 5], [], [4, 6]) == [(2, 0)]


def test_positions_and_seven_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"p{rng.randint(0, 9)}", rng.randint(0, 5), rng.randint(6, 9), rng.choice(["X", "Y"]), rng.choice(["k", "j"]), f"c{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "source_id string, uri string, start int, end int, rule_id string, unit_kind string, case_id string")
    keys = inventory.order_keys(["b", "a"], ["Y", "X"], ["k", "j"])
    named = [f"o{i}" for i in range(7)]
    got = inventory.positioned(df.select("*", *(k.alias(n) for k, n in zip(keys, named))).repartition(7), named).orderBy("position").collect()
    want = sorted(rows, key=lambda r: ("ba".index(r[0]), r[1], r[2], r[3], "YX".index(r[4]), "kj".index(r[5]), r[6]))
    assert [r.position for r in got] == list(range(1, 501)) and [tuple(r)[:7] for r in got] == want
    with pytest.raises(Exception, match="no rank: b"):
        df.select(inventory.rank_of(F.col("source_id"), ["a"])).collect()


def test_caps_hold_for_hot_rules(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)] + [("free", i) for i in range(40)] + [("none", 1)]
    df = spark.createDataFrame(rows, "rule_id string, n int").repartition(6)
    kept = inventory.capped(df, {"hot": 100, "cold": 10, "none": 0}, ["n"], salts=8).collect()
    by = {k: sorted(r.n for r in kept if r.rule_id == k) for k in ("hot", "cold", "free", "none")}
    assert by == {"hot": list(range(100)), "cold": list(range(5)), "free": list(range(40)), "none": []}


def test_totals_leave_documents_out(spark):
    df = spark.createDataFrame([("a", "procedural", 3, 1, 2, 0), ("b", "procedural", 4, 1, 0, 1), ("c", "descriptive", 5, 2, 1, 1)], "uri string, text_type string, sentences int, paragraphs int, semicolons int, list_runs int")
    got = {r.rule_id: (r.units, r.cap, r.status) for r in inventory.rule_totals(df, {"SENT-001": 2, "SEMI-001": 3}, {"SENT-001": ["b"]}).collect()}
    assert got == {"SENT-001": (3, 2, "EXCEEDED"), "SENT-002": (5, None, None), "PARA-001": (2, None, None), "SEMI-001": (3, 3, "OK"), "LIST-001": (2, None, None)}
    assert {r.units for r in inventory.rule_totals(df.limit(0), {}).collect()} == {0}


# --- reviews -------------------------------------------------------------------------------------------------------------------------

GOOD = dict(case_id="c1", record_type="literal_semicolon", domain="d", truth="violation", structural_region="visible_prose", expected_diagnostics="1", rationale="why", review_status="approved", reviewed_by="r", reviewer_role="x", reviewed_on="2026-01-31", decision_notes="")


@pytest.mark.parametrize(
    "change, faults",
    [
        ({}, []),
        ({"review_status": "pending"}, ["not_reviewed"]),
        ({"rationale": " why"}, ["padded"]),
        ({"reviewed_by": ""}, ["reviewer"]),
        ({"reviewed_on": "2026-02-30"}, ["date"]),
        ({"review_status": "rejected"}, ["notes"]),
        ({"review_status": "rejected", "decision_notes": "n", "truth": "odd"}, []),
        ({"domain": None}, ["fields"]),
        ({"truth": "non_violation", "expected_diagnostics": "0"}, ["truth"]),
        ({"truth": "out_of_scope"}, ["expected"]),
        ({"truth": "ambiguous", "expected_diagnostics": ""}, []),
        ({"record_type": "zero_semicolon_control", "truth": "non_violation", "expected_diagnostics": "0"}, []),
        ({"record_type": "odd"}, ["record_type"]),
    ],
)
def test_decisions_are_consistent(spark, change, faults):
    df = spark.createDataFrame([GOOD | change], ", ".join(f"{c} string" for c in GOOD))
    assert review.checked(df, review.decision_constraints()).first().faults == faults


SOUND = dict(case_id="c1", record_type="literal_semicolon", truth="violation", structural_region="visible_prose", expected_diagnostics=1, rationale="why", confidence="high", requires_human=False, critical_reason="none")


@pytest.mark.parametrize(
    "change, faults",
    [
        ({}, []),
        ({"truth": "out_of_scope", "expected_diagnostics": 0}, ["region"]),
        ({"truth": "out_of_scope", "expected_diagnostics": 0, "structural_region": "metadata"}, []),
        ({"truth": "ambiguous", "expected_diagnostics": None, "structural_region": "ambiguous"}, ["not_escalated"]),
        ({"truth": "ambiguous", "expected_diagnostics": None, "structural_region": "ambiguous", "requires_human": True, "critical_reason": "unclear"}, []),
        ({"confidence": "low"}, ["not_escalated"]),
        ({"expected_diagnostics": 0, "rationale": " "}, ["expected", "rationale"]),
        ({"critical_reason": "unclear"}, ["reason_without_need"]),
        ({"requires_human": True}, ["need_without_reason"]),
        ({"record_type": "zero_semicolon_control"}, ["truth"]),
        ({"record_type": "odd"}, ["record_type"]),
    ],
)
def test_structured_reviews_are_consistent(spark, change, faults):
    kinds = {"expected_diagnostics": "int", "requires_human": "boolean"}
    df = spark.createDataFrame([SOUND | change], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in SOUND))
    assert review.checked(df, review.structured_constraints()).first().faults == faults


def test_pairs_of_sets_that_share_keys(spark):
    sets = {n: spark.createDataFrame([(k,) for k in ks], "k int") for n, ks in {"a": [1, 2, 2, 3], "b": [3, 4], "c": [5], "d": [2, 3, 9]}.items()}
    assert {tuple(r) for r in review.shared_keys(sets, "k").collect()} == {("a", "b", 1), ("a", "d", 2), ("b", "d", 1)}


def test_list_labels(spark):
    rows = [("found", 0, 0, 2, [], "Take these tools."), ("found", 1, 3, 2, [], "x\nTake these hand-tools:"), ("found", 0, 0, 2, [], "Take these."), ("uncertain", 0, 0, 2, [], "Take these tools."), ("not_found", -1, 0, 2, [], ""), ("found", 2, 0, 2, [], "Take these tools."), ("found", 0, 4, 2, [], "Take these tools."), ("found", 0, 0, 2, ["heading"], "Take these tools.")]
    df = spark.createDataFrame(rows, "lead_in_status string, blank_lines int, indentation int, peers int, blockers array<string>, lead string")
    assert [r.l for r in df.select(review.list_label(F.col("lead")).alias("l")).collect()] == ["violation", "non_violation", "out_of_scope", "ambiguous", *["out_of_scope"] * 4]


def test_punctuation_labels_need_reviews(spark):
    df = spark.createDataFrame([("a", "visible_prose", True), ("b", "markup_or_code", False)], "case_id string, structural_context string, seen boolean")
    label = review.punctuation_label(F.col("seen")).alias("l")
    assert [r.l for r in df.select(label).collect()] == ["violation", "non_violation"]
    for row, why in ((("c", "visible_prose", False), "visible but not reviewed: c"), (("c", "markup_or_code", True), "reviewed but markup: c"), (("c", "uncertain", True), "needs a decision: c")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([row], df.schema).select(label).collect()


def test_sentence_labels_and_overlapping_sets(spark):
    units = spark.createDataFrame([("a", "uncertain", "complete"), ("b", "markup_or_code", "complete"), ("c", "visible_prose", "incomplete"), ("d", "visible_prose", "complete"), ("e", "visible_prose", "complete"), ("f", "visible_prose", "complete")], "case_id string, structural_context string, sentence_status string")
    ids = lambda *ks: spark.createDataFrame([(k,) for k in ks], "case_id string")
    got = review.sentence_labels(units, {"violation": ids("d", "zz"), "ambiguous": ids("e"), "out_of_scope": ids("b")})
    assert [r.label for r in got.orderBy("case_id").collect()] == ["ambiguous", "out_of_scope", "out_of_scope", "violation", "ambiguous", "non_violation"]
    with pytest.raises(Exception, match="reviewed sets overlap: d"):
        review.sentence_labels(units, {"violation": ids("d"), "ambiguous": ids("d")}).collect()


def test_ground_truth_asks_for_the_same_order(spark):
    m = spark.createDataFrame([(f"c{k}", k, "literal_semicolon", "secret") for k in range(50)], "case_id string, rank int, record_type string, text string").repartition(5)
    make = lambda order, **change: spark.createDataFrame([(SOUND | {"case_id": c} | (change if c == "c7" else {})) | {"line": n} for n, c in enumerate(order)], "case_id string, truth string, structural_region string, expected_diagnostics int, rationale string, confidence string, requires_human boolean, critical_reason string, line int").repartition(3)
    ids = [f"c{k}" for k in range(50)]
    got = review.ground_truth(m, make(ids), ["rank"], ["line"], {"review_status": "delegated"})
    assert "text" not in got.columns and [(r.position, r.case_id, r.truth, r.review_status) for r in got.orderBy("position").collect()] == [(k + 1, f"c{k}", "violation", "delegated") for k in range(50)]
    swapped = [*ids[:3], "c4", "c3", *ids[5:]]
    for bad, why in ((make(swapped), "order at 4"), (make(ids[:49]), "order at 50"), (make(ids, expected_diagnostics=0), "review at 8"), (make(ids, requires_human=True, critical_reason="unclear"), "undecided at 8")):
        with pytest.raises(Exception, match=why):
            review.ground_truth(m, bad, ["rank"], ["line"], {}).collect()


def test_preferences_and_leaving_cases_out(spark):
    key = spark.createDataFrame([(f"{c}{s}", c, s, "m") for c in ("x", "y", "z") for s in ("control", "treatment")], "label string, case_id string, condition string, model string")
    first = spark.createDataFrame([("xcontrol", 3, 5, "ok"), ("xtreatment", 4, 9, "ok"), ("ycontrol", 3, 5, "ok"), ("ytreatment", 3, 2, "no"), ("zcontrol", 1, 1, "ok")], "label string, clarity int, findings int, accept_class string")
    second = spark.createDataFrame([("xcontrol", 3, 5, 6, False, "ok"), ("xtreatment", 4, 9, 6, False, "ok"), ("ycontrol", 3, 5, 2, True, "ok"), ("ytreatment", 2, 2, 1, False, "ok"), ("zcontrol", 1, 1, 1, False, "ok")], "label string, clarity int, findings int, s int, blocked boolean, accept_class string")
    scores = review.artifact_scores(key, first, second)
    prefs = review.preferences(scores, ["case_id"])
    assert {tuple(r) for r in prefs.collect()} == {("x", "treatment", "tie"), ("y", "treatment", "treatment")}
    assert {tuple(r) for r in review.leave_one_out(prefs, "case_id").collect()} == {("x", 1, 1, 1.0), ("y", 1, 0, 0.0), (None, 2, 1, 0.5)}
    got = review.agreement(scores).first()
    assert (got.artifacts, got.class_agreement) == (5, 0.8) and got.findings_rho == 1.0
    verdicts = spark.range(1).select(*(review.verdict(F.lit(a), F.lit(b)).alias(f"v{i}") for i, (a, b) in enumerate(((0.7, 0.5), (0.7, 0.4), (0.4, 0.9), (0.3, 0.9))))).first()
    assert list(verdicts) == ["convergent", "mixed", "mixed", "inconclusive"]


def test_scores_without_a_condition_fail(spark):
    scores = spark.createDataFrame([("c", "A", 1), ("c", "B", 2)], "case_id string, label string, n int")
    key = spark.createDataFrame([("c", "A", "control")], "case_id string, label string, condition string")
    with pytest.raises(Exception, match="no condition: c/B"):
        review.unblinded(scores, key).collect()


# --- contracts -----------------------------------------------------------------------------------------------------------------------


def candidate(**change):
    """A sound candidate analysis with some fields changed; "-" drops one."""
    out = {
        "schema_version": "1", "case_id": "c", "document_id": None, "text": "x", "abstention_reason": None, "surface_tokens": [{"text": "x", "start": 0, "end": 1}],
        "words": [{"form": "x", "surface_token_index": 0, "lemma": None, "upos": "X", "xpos": None, "features": [["a", "b"]], "dependency": None, "head_word_index": None, "sentence_index": 0}],
        "sentences": [{"start": 0, "end": 1, "first_surface_token": 0, "past_last_surface_token": 1, "first_word": 0, "past_last_word": 1}],
    }
    out = {k: v for k, v in (out | change).items() if v != "-"}
    return json.dumps(out)


WORD = {"form": "x", "surface_token_index": 0, "lemma": None, "upos": "X", "xpos": None, "features": None, "dependency": None, "head_word_index": 3, "sentence_index": 0}


@pytest.mark.parametrize(
    "text, faults",
    [
        (candidate(), []),
        (candidate(words=[WORD], surface_tokens=[], sentences=[]), []),
        (candidate(words=[], abstention_reason="why"), []),
        (candidate(document_id="-"), ["fields"]),
        (candidate(more=1), ["fields"]),
        (candidate(case_id=3), ["scalars"]),
        (candidate(sentences={}), ["collections"]),
        (candidate(surface_tokens=[{"text": "x", "start": True, "end": 1}]), ["token_fields"]),
        (candidate(surface_tokens=["x"]), ["token_fields"]),
        (candidate(words=[WORD | {"head_word_index": False}]), ["word_fields"]),
        (candidate(words=[WORD | {"upos": 1}]), ["word_fields"]),
        (candidate(words=[WORD | {"features": [["a"]]}]), ["features"]),
        (candidate(words=[WORD | {"features": "a"}]), ["features"]),
        (candidate(sentences=[{"start": 0}]), ["sentence_fields"]),
        (candidate(abstention_reason=1), ["abstention"]),
        ("[1]", ["not_json"]),
        ("{", ["not_json"]),
        (None, ["not_json"]),
    ],
)
def test_candidate_shapes(spark, text, faults):
    df = spark.createDataFrame([("c", text)], "id string, json string")
    assert contracts.candidate_faults(df).first().faults == faults


def test_forbidden_fields_are_found_however_deep(spark):
    df = spark.createDataFrame([], "case_id string, a struct<b: array<struct<Truth: int>>>, m map<string, struct<text: int>>")
    assert contracts.without(df, ["label"]) is df
    with pytest.raises(ValueError, match="a.b.Truth, m.text"):
        contracts.without(df, ["truth", "text"])


def test_blind_inputs_and_abstentions(spark):
    gold = spark.createDataFrame([("a", "d", "x", None, 1), ("b", None, "y", "markup", 2)], "case_id string, document_id string, text string, abstention_reason string, words int")
    inputs = contracts.blind_inputs(gold)
    assert inputs.columns == list(contracts.BLIND)
    parts = "case_id string, surface_tokens array<int>, words array<int>, sentences array<int>"
    got = {r.case_id: (r.surface_tokens, r.words) for r in contracts.analysed(inputs, spark.createDataFrame([("a", [1], [2], [3]), ("b", [4], [5], [6])], parts)).collect()}
    assert got == {"a": ([1], [2]), "b": ([], [])}
    with pytest.raises(Exception, match="no analysis: a"):
        contracts.analysed(inputs, spark.createDataFrame([], parts)).collect()
    with pytest.raises(Exception, match="not an input: b"):
        contracts.blind_inputs(gold.filter("case_id = 'b'").withColumn("abstention_reason", F.lit(""))).collect()


def test_analysis_invariants(spark):
    texts = spark.createDataFrame([("a", "One two. Ha")], DOC)
    T = [("a", 0, 0, 3, "One"), ("a", 1, 4, 7, "two"), ("a", 2, 7, 8, "."), ("a", 3, 9, 11, "Ha")]
    S = [("a", 0, 0, 8, 0, 3, 0, 3), ("a", 1, 9, 11, 3, 4, 3, 4)]
    W = [("a", 0, 0, 0, 1), ("a", 1, 0, 1, None), ("a", 2, 0, 2, 1), ("a", 3, 1, 3, None)]
    put = lambda rows, n, row: [*rows[:n], row, *rows[n + 1 :]]

    def faults(t=T, s=S, w=W):
        tokens = spark.createDataFrame(t, "uri string, token int, start int, end int, text string")
        sentences = spark.createDataFrame(s, "uri string, sentence int, start int, end int, first_token int, past_last_token int, first_word int, past_last_word int")
        words = spark.createDataFrame(w, "uri string, word int, sentence int, token int, head int")
        return {(r.fault, r.n) for r in contracts.analysis_faults(texts, tokens, sentences, words).collect()}

    assert faults() == set()
    assert faults(t=put(T, 1, ("a", 1, 2, 7, "two"))) == {("token_order", 1), ("token_slice", 1)}
    assert faults(w=put(W, 1, ("a", 1, 0, 1, 0))) == {("roots", 1)}
    assert faults(w=put(W, 0, ("a", 0, 0, 0, 3))) == {("head_outside", 1)}
    assert faults(w=put(W, 3, ("a", 3, 1, 0, None))) == {("word_token", 1)}
    assert faults(s=put(S, 1, ("a", 1, 9, 10, 3, 4, 3, 4))) == {("sentence_span", 1)}
    assert faults(s=S[:1]) == {("sentence_partition", 1), ("word_sentence", 1), ("word_token", 1)}
    assert faults(s=[], w=[]) == {("coverage", 1)}


def test_damaged_packets_of_long_pages_agree_with_their_sql(spark, tmp_path):
    import duckdb

    pages = [(1, "u", ("x" * 98 + ";\n") * 1_200), (2, "u", "x;y\n;"), (4, "u", None), (7, "u", None), (10, "u", "none"), (13, "u", "")]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(at)
    got = queries.QUERIES["packet_integrity"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = con.execute(f"SELECT fault, records FROM ({queries.ORACLES['packet_integrity']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and dict(want)["column"] == 1_200


def test_packets_are_held_against_the_documents(spark):
    import hashlib

    text = "é;\nab;"
    sha = hashlib.sha256(text.encode()).hexdigest()
    docs = spark.createDataFrame([("a", text), ("b", "none")], DOC)
    rows = [("1", "literal_semicolon", "a", sha, 1, 2, 2), ("2", "literal_semicolon", "a", sha, 5, 6, 3), ("3", "literal_semicolon", "a", sha, 4, 9, 3), ("4", "literal_semicolon", "a", "0", 99, 2, 2), ("5", "zero_semicolon_control", "a", sha, None, None, None), ("6", "odd", "b", "0", None, None, None), ("7", "literal_semicolon", "c", sha, 1, 1, 1), ("2", "zero_semicolon_control", "b", hashlib.sha256(b"none").hexdigest(), None, None, None)]
    df = spark.createDataFrame(rows, "case_id string, record_type string, uri string, file_sha256 string, offset int, byte_offset int, column int")
    got = sorted((r.case_id, tuple(r.faults)) for r in contracts.packet_faults(df, docs).collect())
    assert got == [("2", ("duplicate",)), ("2", ("duplicate",)), ("3", ("not_a_semicolon", "byte_offset", "column")), ("4", ("file_digest", "not_a_semicolon", "byte_offset", "column")), ("5", ("control_has_semicolon",)), ("6", ("file_digest", "record_type")), ("7", ("no_document",))]


def test_registered_counts_logs_artifacts_and_serialisation(spark):
    counts = spark.createDataFrame([(3, 4)], "files int, marks int")
    assert [tuple(r) for r in contracts.count_faults(counts, {"files": 3, "marks": 5}).collect()] == [("marks", 5, 4)]
    logs = spark.createDataFrame([("quillspark  lint x", None), ("done: LINT exit 0", ""), ('{"exit_code" : 0}', "QUILLSPARK"), ('{"exit_code": 0}', ""), ("lint exit 01", None), (None, None)], "o string, e string")
    assert [r.l for r in logs.select(contracts.lint_invoked(F.col("o"), F.col("e")).alias("l")).collect()] == [True, True, True, False, False, False]
    paths = spark.createDataFrame([(p,) for p in ("r/m/cli/case-12-run-01/b.md", "r/m/cli/case-12-run-01/a.md", "r/m/control/other/c.md", "r/m/cli/empty/x.txt", "a.md")], "path string")
    assert {(r.condition, r.case_id, r.path) for r in contracts.run_artifacts(paths).collect()} == {("cli", "case-12", "r/m/cli/case-12-run-01/a.md"), ("control", "other", "r/m/control/other/c.md")}
    df = spark.createDataFrame([("u", "secret", [("hid", 1)])], "uri string, text string, tokens array<struct<text:string,start:int>>")
    assert [tuple(r) for r in contracts.without_text(df).collect()] == [("u", '{"tokens":[{"start":1}],"uri":"u"}')]


def test_scan_counts(spark):
    text = "# Head.\n\nOne. Two! Three\n- a item.\n- b; more\n  and on.\n\n> quote? yes\n\n```\nx; y.\n```\nEnd of 3.14"
    got = projection.scan_counts(spark.createDataFrame([("a", text), ("b", None)], DOC)).orderBy("uri").collect()
    assert [tuple(r) for r in got] == [("a", 5, 3, 2, 2, 1), ("b", 0, 0, 0, 0, 0)]


def test_terms_that_clash_when_folded(spark):
    entry = lambda term, cased, pos="noun": dict(term=term, part_of_speech=pos, meaning_id="m", case_sensitive=cased)
    for clash in ([entry("Ab", True), entry("ab", False)], [entry("Ab", False), entry("aB", False)], [entry("Ab", True), entry("Ab", True)], [entry("straße", False), entry("STRASSE", True)]):
        with pytest.raises(ValueError, match="twice"):
            vocabulary.read_source(json.dumps({"entries": clash}))
        assert vocabulary.clashes(vocabulary.table(spark, clash)).first().entries == 2
    fine = [entry("Ab", True), entry("ab", True), entry("ab", False, "verb")]
    assert vocabulary.read_source(json.dumps({"entries": fine})) == fine and vocabulary.clashes(vocabulary.table(spark, fine)).count() == 0


def test_analyses_made_over_documents_are_checked_where_they_lie(spark):
    from quillspark.plans.evidence import faulty_analysis

    docs = spark.createDataFrame([("a", "Aa bb. Cc dd. Ee ff gg. Hh."), ("b", ""), ("c", "1. 2.")], DOC)
    found = contracts.parsed_faults(docs, lambda doc: faulty_analysis(doc["text"]))
    assert {tuple(r) for r in found.collect()} == {("a", "roots", 2), ("a", "head_outside", 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_records_found_in_a_walk_are_those_of_unit_rows(spark):
    own = {"source_id": "s", "text_type": "procedural", "rule_id": "SENT-001", "unit_kind": "k", "structural_context": "visible_prose"}
    spans = {"a": [(0, 3), (5, 9)], "b": [(1, 99)], "c": []}
    docs = spark.createDataFrame([("a", "One.\nTwo.\n"), ("b", "x\ny"), ("c", "")], DOC)
    units = spark.createDataFrame([(u, a, b, *own.values()) for u, ss in spans.items() for a, b in ss], "uri string, start int, end int, " + ", ".join(f"{n} string" for n in own))
    found = inventory.found_records(docs, lambda doc: [{"start": a, "end": b, **own} for a, b in spans[doc["uri"]]])
    assert sorted(map(str, found.collect())) == sorted(map(str, inventory.records(units, docs).collect())) and found.count() == 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_rule_or_a_part(spark):
    df = spark.range(20_000).select(F.lit("one").alias("rule_id"), F.lit("one").alias("part"), F.col("id").alias("n"), (F.col("id") % 100 != 7).cast("int").alias("v"))
    whole, cut = inventory.capped(df, {"one": 10**9}, ["n"]), inventory.capped(df, {"one": 15_000}, ["n"])
    assert whole.count() == 20_000 and (cut.count(), cut.agg(F.max("n")).first()[0]) == (15_000, 14_999)
    wrong = inventory.order_faults(df, [F.col("v")], "part", "n")
    assert sorted(r.n for r in wrong.collect()) == list(range(7, 20_000, 100))
    plans = "".join(x._jdf.queryExecution().optimizedPlan().toString() for x in (whole, cut, wrong))
    assert "windowspecdefinition(rule_id#" not in plans and "windowspecdefinition(part#" not in plans
