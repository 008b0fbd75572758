"""Rules and parsing on small documents whose findings are known."""

import random

import pytest

from quillspark.operators import baseline, plain, rules, scanner
from quillspark.operators.catalog import Catalog, Context, Rule, lint, read_config
from quillspark.operators.markdown import lintable_text, mask, region_sentences, region_tokens, runs, with_regions

DOC = "uri string, text string"


def frame(spark, *docs):
    return spark.createDataFrame([(f"{i}.{kind}", text) for i, (kind, text) in enumerate(docs)], DOC)


def found(df, rule_id, **options):
    rows = lint(df, rules.CATALOG, [rule_id], Context(options)).collect()
    return sorted((r.uri, r.start, r.end, r.start_line, r.start_column) for r in rows)


def words(n):
    return " ".join(["word"] * n)


def test_sentence_length_at_the_limit(spark):
    df = frame(spark, ("txt", words(20) + "."), ("txt", "Short. " + words(21) + "."), ("txt", words(20) + " re-use."), ("txt", words(21)), ("md", "# Head\n\n" + words(21) + "."))
    assert found(df, "SENT-001", text_type="procedural") == [("1.txt", 7, 7 + 21 * 5, 1, 8), ("4.md", 8, 8 + 21 * 5, 3, 1)]
    assert found(df, "SENT-001", text_type="descriptive") == [] and found(df, "SENT-001") == []
    df = frame(spark, ("txt", words(25) + "!"), ("txt", words(26) + "!"))
    assert [x[0] for x in found(df, "SENT-002", text_type="descriptive")] == ["1.txt"]


def test_paragraph_length(spark):
    six, seven = "One two. " * 6, "One two. " * 7
    df = frame(spark, ("txt", six), ("txt", seven), ("txt", "One two. " * 4 + "\n\n" + "One two. " * 4), ("md", seven), ("md", seven + "`x` y."), ("txt", seven + "open"))
    assert [x[:3] for x in found(df, "PARA-001", text_type="descriptive")] == [("1.txt", 0, len(seven) - 1), ("3.md", 0, len(seven) - 1)]


def test_semicolons(spark):
    df = frame(spark, ("txt", "a; b\n;c;"), ("md", "`a;b` then; and $x;y$\n\n```\nz;\n```\n<!-- ; -->"), ("txt", "none"), ("md", "&amp; [l;abel](http://x;y)"))
    assert found(df, "SEMI-001") == [("0.txt", 1, 2, 1, 2), ("0.txt", 5, 6, 2, 1), ("0.txt", 7, 8, 2, 3), ("1.md", 10, 11, 1, 11), ("3.md", 8, 9, 1, 9)]


@pytest.mark.parametrize(
    "text, at",
    [
        ("Use these tools.\n- hammer\n- saw\n", 15),
        ("Use these tools.\n\n- hammer\n- saw\n", 15),
        ("Use these tools.\n\n\n- hammer\n- saw\n", None),
        ("Use these tools:\n- hammer\n- saw\n", None),
        ("Use these tools.\n- hammer\n", None),
        ("Use these.\n- hammer\n- saw\n", None),
        ("Use these `good` tools.\n- hammer\n- saw\n", None),
        ("First. Take these hand-tools.\n1. hammer\n2. saw\n", 28),
        ("begun here\nand these tools.\n- hammer\n- saw\n", None),
        ("Use these tools.\n- hammer\n  - saw\n", None),
    ],
)
def test_list_lead_in(spark, text, at):
    assert [x[1] for x in found(frame(spark, ("md", text)), "LIST-001")] == ([] if at is None else [at])
    assert found(frame(spark, ("txt", text)), "LIST-001") == []


def test_parses_feed_the_language_rules(spark):
    rows = [
        ("0.txt", 0, 0, 2, "NOUN", "NN", "nsubjpass", 0, 4, "pump", False), ("0.txt", 0, 1, 2, "AUX", "VBZ", "auxpass", 5, 7, "is", False),
        ("0.txt", 0, 2, 2, "VERB", "VBN", "ROOT", 8, 15, "stopped", False), ("0.txt", 0, 3, 2, "ADP", "IN", "agent", 16, 18, "by", False),
        ("0.txt", 1, 0, 0, "VERB", "VB", "ROOT", 30, 34, "Stop", True), ("0.txt", 2, 0, 1, "PRON", "PRP", "nsubj", 40, 42, "it", True), ("0.txt", 2, 1, 1, "VERB", "VB", "ROOT", 43, 47, "runs", True),
    ]
    parses = spark.createDataFrame(rows, "uri string, sentence int, i int, head int, pos string, tag string, dep string, start int, end int, text string, in_note boolean")
    df = frame(spark, ("txt", "x" * 60))
    context = Context(tables={"parses": parses})
    get = lambda rule: [(r.start, r.end) for r in lint(df, rules.CATALOG, [rule], context).collect()]
    assert get("PASV-001") == [(8, 15)] and get("NOTE-001") == [(30, 34)]
    assert lint(df, rules.CATALOG, ["PASV-001"]).count() == 0


def test_sentences_cross_lines_and_markup(spark):
    df = frame(spark, ("txt", "  One\ntwo. Three! four"), ("md", "One `code` two. [Three](x) four.\n\nlast"))
    plain_rows = [(r.start, r.end, r.complete) for r in plain.sentences(df.filter("uri = '0.txt'")).orderBy("start").collect()]
    assert plain_rows == [(2, 10, True), (11, 17, True), (18, 22, False)]
    parts = region_sentences(with_regions(df.filter("uri = '1.md'"))).orderBy("start").collect()
    assert [r.complete for r in parts] == [True, True, False]
    assert [[tuple(p) for p in r.parts] for r in parts] == [[(0, 4), (10, 15)], [(17, 22), (26, 32)], [(34, 38)]]


def test_tokens_rebuild_any_text(spark):
    rng = random.Random(11)
    alphabet = "aé1_ -'`*#>|\n\r\t.;!?()[]<>&$~\\中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], DOC)
    got = {}
    for r in region_tokens(with_regions(df)).orderBy("uri", "start").collect():
        got.setdefault(r.uri, []).append(r)
    for i, t in enumerate(texts):
        at = 0
        for r in got[f"{i}.md"]:
            assert r.start == at and t[r.start : r.end] == r.text
            at = r.end
        assert at == len(t)
        on = mask(t)
        assert len(on) == len(t) and [b for _, b, _ in runs(on)][-1] == len(t)
    assert plain.partition_faults(plain.tokens(df), df).count() == 0


@pytest.mark.parametrize(
    "text, kept",
    [
        ("---\na: b\n---\ntext", "text"),
        ("---\na: b\ntext", "---\na: b\ntext"),
        ("```\nx\n", ""),
        ("a\n~~~~\nb\n~~~\n~~~~~\nc", "a\nc"),
        ("# Head\ntext", "text"),
        ("Head\n====\ntext", "text"),
        ("- item\n> quote", "item\nquote"),
        ("a | b\n---|:---\n1 | 2\ntext", "text"),
        ("a <b>c</b> &amp; d", "a c  d"),
        ("![i](u) [l](u) http://x.y/z", " l "),
        ("a ``b`c`` d `e", "a  d e"),
        ("x $a$ y $b", "x  y $b"),
        (r"\* a *b* (~c~) 2 < 3", " a b (c) 2 < 3"),
        ("    code\ntext", "text"),
        ("::: tip\ntext\n:::", "text\n"),
        ("[a]: http://x\ntext", "text"),
    ],
)
def test_mask(text, kept):
    assert "".join(c for c, m in zip(text, mask(text)) if not m) == kept


def test_older_profile_keeps_comments(spark):
    text = "a <!-- ; --> $b$ http://x.y"
    assert "".join(c for c, m in zip(text, mask(text, full=False)) if not m) == text
    assert with_regions(frame(spark, ("md", "x `y` z"))).select(lintable_text().alias("t")).first().t == "x  z"
    with pytest.raises(Exception, match="unsupported suffix"):
        with_regions(frame(spark, ("html", "x"))).collect()


def test_baseline_survives_moves_and_tells_repeats_apart(spark):
    line = words(21) + ". "
    before, moved, more = (frame(spark, ("txt", t)) for t in ("a.\n" + line, "new line.\n\na.\n" + line, "a.\n" + line + "\n" + line))
    opts = Context({"text_type": "procedural"})
    mark = lambda df: baseline.fingerprints(lint(df, rules.CATALOG, ["SENT-001"], opts), df)
    base = baseline.baseline_of(mark(before))
    text = baseline.to_json(base)
    again = baseline.from_json(text)
    assert baseline.unknown(mark(before), again).count() == 0
    assert baseline.unknown(mark(moved), again).count() == 0
    assert baseline.unknown(mark(more), again).count() == 1
    assert "word" not in text.first().json
    for bad in ('{"schema_version":"1.0","fingerprints":["x"]}', '{"schema_version":"2.0","fingerprints":[]}', '{"schema_version":"1.0","fingerprints":[],"more":1}'):
        with pytest.raises(Exception):
            baseline.from_json(spark.createDataFrame([(bad,)], "json string")).collect()


def test_catalog_and_selection():
    rule = rules.CATALOG.rules["SENT-001"]
    with pytest.raises(ValueError):
        Catalog([rule, rule])
    with pytest.raises(ValueError):
        Rule("bad", "t", "s", "m", rule.find)
    with pytest.raises(ValueError):
        Rule("SENT-009", "t", "s", "m", rule.find, severity="error")
    pick = rules.CATALOG.selected
    assert pick() == [] and pick({"enable": ["SEMI-001", "SENT-001"]}, {"disable": ["SEMI-001"]}) == ["SENT-001"]
    for bad in ({"enable": ["NOPE-001"]}, {"enable": ["SEMI-001", "SEMI-001"]}, {"enable": ["SEMI-001"], "disable": ["SEMI-001"]}):
        with pytest.raises(ValueError):
            pick(bad)
    assert read_config('schema_version = 1\ntext_type = "procedural"\n[rules]\nenable = ["SEMI-001"]') == ({"enable": ["SEMI-001"]}, {"text_type": "procedural"})
    for bad in ("schema_version = 2", "schema_version = 1\nother = 3", 'schema_version = 1\n[glossary]\nterms = ["A", "a"]'):
        with pytest.raises(ValueError):
            read_config(bad)


def test_a_span_outside_its_text_fails(spark):
    from pyspark.sql import functions as F

    bad = Rule("TEST-001", "t", "s", "m", lambda docs, ctx: docs.select("uri", F.lit(0).alias("start"), F.lit(99).alias("end"), F.lit("").alias("evidence")))
    with pytest.raises(Exception, match="invalid span"):
        lint(frame(spark, ("txt", "abc")), Catalog([bad]), ["TEST-001"]).collect()


def test_scanner(spark):
    text = "# Head\n\nOne sentence. Another one; with more\n\n- a item\n  - nested one\n  - nested two\n- b item\n\n```\ncode; here\n```\n\nLast words"
    df = frame(spark, ("md", text), ("md", "prose\n\n```\nnever closed;\n"))
    kinds = [r.kind for r in scanner.lines(df.filter("uri = '0.md'")).orderBy("k").collect()]
    assert kinds == ["structural", "blank", "prose", "blank", "list", "list", "list", "list", "blank", "structural", "structural", "structural", "blank", "prose"]
    n = {r.uri: r for r in scanner.counts(df).collect()}
    assert (n["0.md"].list_runs, n["0.md"].semicolons, n["0.md"].paragraphs, n["0.md"].complete) == (2, 1, 2, 1)
    assert scanner.units(df.filter("uri = '1.md'")).filter("uncertain and unit_kind = 'punctuation' and status = 'uncertain'").count() == 1
    ls = scanner.lines(df)
    led = scanner.lead_ins(scanner.list_runs(ls), scanner.blocks(ls)).orderBy("start").collect()
    assert text[led[0].lead_in_start : led[0].lead_in_end].startswith("One sentence") and led[0].peers == 2
    first = scanner.lead_ins(scanner.list_runs(scanner.lines(frame(spark, ("md", "- a\n- b\n")))), scanner.blocks(scanner.lines(frame(spark, ("md", "- a\n- b\n"))))).first()
    assert (first.lead_in_start, first.lead_in_end, first.lead_in_kind) == (-1, -1, "")
    units = spark.createDataFrame([("a", 0, 5, "complete", 21, False), ("a", 6, 9, "tail", 3, False), ("a", 10, 12, "complete", 1, True), ("a", 13, 15, "complete", 1, False)], "uri string, start int, end int, status string, words int, uncertain boolean")
    fixed = spark.createDataFrame([("a", 13, 15, "violation")], "uri string, start int, end int, label string")
    assert [r.label for r in scanner.proposed_labels(units, fixed).orderBy("start").collect()] == ["violation", "out_of_scope", "ambiguous", "violation"]


def test_list_lead_ins_make_no_line_rows(spark):
    text = "`x;`\nUse these tools.\n\n- hammer\n- saw.\n" + "More of these items.\n- a\n- b.\n" * 3_000 + "open\n these nuts.\n- a\n- b\n"
    df = rules.list_lead_ins(frame(spark, ("md", text)), Context())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()  # rows of lines held a text each and were shuffled
    assert df.count() == 3_001


def test_tokens_are_placed_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", "Ab-c 😀d.  É1"), ("b", ""), ("c", None), ("d", "x")], DOC)
    got = plain.tokens(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in got.filter("uri = 'a'").orderBy("ordinal").collect()] == [(0, 0, 4, "Ab-c"), (1, 4, 5, " "), (2, 5, 6, "😀"), (3, 6, 7, "d"), (4, 7, 8, "."), (5, 8, 10, "  "), (6, 10, 12, "É1")]
    assert [tuple(r) for r in got.filter("uri <> 'a'").collect()] == [("d", 0, 0, 1, "x")]


def test_documents_that_tokens_do_not_rebuild(spark, monkeypatch):
    df = spark.createDataFrame([("a", "ab cd"), ("b", "ab"), ("c", ""), ("d", None)], DOC)
    assert plain.token_faults(df).count() == 0
    monkeypatch.setattr(plain, "TOKEN", "[a-z]+")
    found = plain.token_faults(df)
    assert [r.uri for r in found.collect()] == ["a"] and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_regions_from_edges():
    import numpy as np

    from quillspark.operators.markdown import edges

    for cover in ([], [True], [False, False], [True, False, False, True]):
        start, end, lintable = edges(np.array(cover, bool))
        assert {x.dtype for x in (start, end)} == {np.dtype(np.int32)}  # numbers as they lie, no object for each region
        assert [on for a, b, on in zip(start, end, lintable) for _ in range(b - a)] == [not x for x in cover] and (lintable[1:] != lintable[:-1]).all()


def test_regions_of_many_documents_at_once(spark):
    texts = ["a `b` c", "", "# h", "x"]
    df = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)] + [("4.txt", "`x`"), ("5.md", None)], DOC).coalesce(1)
    got = {r.uri: [tuple(x) for x in r.regions] for r in with_regions(df).collect()}
    assert got == {"0.md": [(0, 2, True), (2, 5, False), (5, 7, True)], "1.md": [], "2.md": [(0, 3, False)], "3.md": [(0, 1, True)], "4.txt": [(0, 3, True)], "5.md": []}
    assert "ArrowEvalPython" in with_regions(df)._jdf.queryExecution().executedPlan().toString()


def test_only_sentences_that_may_be_long_leave_the_walk(spark):
    df = frame(spark, ("txt", "Short one. " + words(21) + ". " + words(20) + ". " + words(30)))
    got = plain.long_sentences(df, 20).collect()
    assert [(r.ordinal, r.start) for r in got if len(r.text.split()) > 20] == [(1, 11)]
    assert all(r.complete and r.ordinal > 0 for r in got)


def test_a_walk_holds_no_more_characters_than_told():
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_pydict({"uri": ["a", "b"]})])))

    made = plain.walked(Frame(), "context string, n int", lambda doc: (("x" * 1_000_000, k) for k in range(10)))
    assert [b.num_rows for b in made if b.num_rows] == [4, 4, 4, 4, 4] and sum(b.num_rows for b in made) == 20


def test_a_baseline_in_parts(spark):
    import hashlib

    prints = [f"sha256:{hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(300)]
    base = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    parts = baseline.to_json_parts(base, 1)
    assert parts.count() == 16 and max(r.json.count("sha256:") for r in parts.collect()) < 60
    assert sorted(r.fingerprint for r in baseline.from_json(parts).collect()) == sorted(prints)
    whole = baseline.to_json(base).first().json
    assert "".join(r.json[17 : r.json.index("]")] + "," for r in parts.orderBy("part").collect()).rstrip(",") == whole[17 : whole.index("]")]
    with pytest.raises(Exception, match="not a baseline"):
        baseline.from_json(parts.filter("part = 'sha256:0'").selectExpr("'sha256:1' as part", "json")).collect()


def test_documents_are_dealt_in_shares_that_do_not_grow(spark, monkeypatch):
    from quillspark.plans import queries

    monkeypatch.setattr(queries, "TASK_DOCS", 5, raising=False)
    docs = queries.spread_documents(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() == -(-docs.count() // 5) > 2 * spark.sparkContext.defaultParallelism
