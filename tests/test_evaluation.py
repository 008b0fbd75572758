"""Metrics, samples, studies, parses and vocabulary on figures worked out by hand."""

import hashlib
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quillspark.functions.place import byte_of, only_place, window_around
from quillspark.operators import holdout, metrics, overlap, parses, study, vocabulary
from quillspark.plans import evidence  # noqa: F401  (registers its queries)
from quillspark.plans import registry as plans


def wilson(k, n, z=1.959963984540054):
    p = k / n
    mid, half = p + z * z / (2 * n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def test_published_matrix(spark):
    """148 / 4 / 15 / 242 gives precision 0.973684 [0.934296; 0.989720] and recall 0.907975 [0.853726; 0.943438]."""
    m = spark.createDataFrame([(148, 4, 15, 242, 150220), (0, 0, 0, 9, 0)], "tp int, fp int, fn int, tn int, words int")
    a, b = metrics.with_metrics(m, "words").orderBy(F.desc("tp")).collect()
    shown = [round(x, 6) for x in (a.precision, a.precision_low, a.precision_high, a.recall, a.recall_low, a.recall_high, a.fp_per_1000_words)]
    assert shown == [0.973684, 0.934296, 0.98972, 0.907975, 0.853726, 0.943438, 0.026628]
    assert b.precision is None and b.precision_low is None and b.fp_per_1000_words is None
    assert metrics.with_metrics(m.filter("tp = 0"), empty=0.0).first().recall_high == 0.0
    assert metrics.gate(metrics.with_metrics(m), {"precision": 0.95}).orderBy(F.desc("tp")).select("passed").collect() == [(True,), (False,)]
    need = metrics.extra_hits_needed(m.filter("tp > 0").drop("words")).first().extra_tp
    assert wilson(148 + need, 152 + need)[0] >= 0.95 > wilson(147 + need, 151 + need)[0]


def test_extra_hits_have_no_cap(spark):
    rows = [(tp, fp) for tp in (0, 1, 100, 5000) for fp in (0, 1, 50, 1000, 1050, 40_000)]
    m = spark.createDataFrame(rows, "tp long, fp long")
    for goal in (0.5, 0.95):
        for r in metrics.extra_hits_needed(m, goal).collect():
            low = lambda x: wilson(r.tp + x, r.tp + r.fp + x)[0] if r.tp + r.fp + x else 0.0
            assert low(r.extra_tp) >= goal and (r.extra_tp == 0 or low(r.extra_tp - 1) < goal), (r, goal)


def test_conventions_differ(spark):
    rows = [("d", label, hit) for label in metrics.LABELS for hit in (True, False)]
    units = spark.createDataFrame(rows, "domain string, label string, emitted boolean")
    cell = lambda how: tuple(metrics.confusion(units, ["domain"], how).select("tp", "fp", "fn", "tn").first())
    assert cell("strict") == (1, 2, 1, 1) and cell("conservative") == (1, 3, 2, 1) and cell("holdout") == (1, 2, 1, 2)
    both = {r.domain: r.fp for r in metrics.confusion_with_total(units, "domain", stray=5).collect()}
    assert both == {"d": 2, None: 7}
    stray = spark.createDataFrame([("d", 4)], "domain string, n long")
    assert metrics.confusion(units, ["domain"], "strict", stray).first().fp == 6


def test_matching(spark):
    units = spark.createDataFrame([("a", 0, 5, "sentence", 0), ("a", 9, 12, "list", 8)], "uri string, start int, end int, unit_kind string, lead_in_end int")
    spans = spark.createDataFrame([("a", 7, 8), ("a", 7, 8), ("b", 0, 1), ("b", 0, 1)], "uri string, start int, end int")
    want = metrics.expected_spans(units)
    assert [r.emitted for r in metrics.emitted(want, spans, ["uri", "start", "end"]).orderBy("start").collect()] == [False, True]
    assert metrics.unmatched(spans, want, ["uri", "start", "end"]).count() == 2
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {tuple(r) for r in metrics.unmatched_keys(left, right, ["k"]).collect()} == {(2, 2, 1), (3, 0, 1)}
    x, y = spark.createDataFrame([("a", 0.1, None)], "k string, v double, w double"), spark.createDataFrame([("a", 0.1 + 1e-17, None)], "k string, v double, w double")
    assert metrics.agree(x, y, ["k"], ["v", "w"]).count() == 0 and metrics.agree(x, y.withColumn("v", F.lit(0.2)), ["k"], ["v"]).count() == 1


def test_holdout(spark):
    docs = spark.createDataFrame([("a.txt", "é;\nb;c;"), ("b.txt", "none")], "uri string, text string")
    got = [tuple(r)[1:] for r in holdout.occurrences(docs).orderBy("offset").collect()]
    assert got == [(1, 1, 2, 1, 2), (2, 4, 5, 2, 2), (3, 6, 7, 2, 4)]
    keys = [f"k{i}" for i in range(30)]
    want = sorted(keys, key=lambda k: hashlib.sha256(f"salt\0{k}".encode()).hexdigest())[:5]
    sample = holdout.hash_sample(spark.createDataFrame([(k,) for k in keys], "k string"), F.col("k"), "salt", 5)
    assert [r.k for r in sample.collect()] == want
    numbers = holdout.numbered(spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(5), ["v"], "case").collect()
    assert sorted((r.v, r.case_id) for r in numbers) == [(i, f"case-{i + 1:04d}") for i in range(101)]
    sent = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, u string, v string")
    back = spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, "c", "z")], "k int, u string, v string")
    assert sorted(r.k for r in holdout.changed_fields(sent, back, "k", ["u", "v"]).collect()) == [2, 3]
    safe = spark.createDataFrame([("=1+1",), ("ok",)], "v string").select(holdout.csv_safe(F.col("v")).alias("v")).collect()
    assert [r.v for r in safe] == ["'=1+1", "ok"]
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert holdout.combined_digest(files).first().digest == hashlib.sha256(b"a\x001\nb\x002\n").hexdigest()
    packet = holdout.review_packet(holdout.occurrences(docs), docs, 0).orderBy("offset").first()
    assert packet.context == "é;" and packet.context_sha256 == hashlib.sha256("é;".encode()).hexdigest()


def test_places(spark):
    df = spark.createDataFrame([("aébcb\nx\ny\nz",)], "t string")
    row = df.select(byte_of(F.col("t"), F.lit(2)).alias("b"), only_place(F.col("t"), F.lit("éb")).alias("one"), only_place(F.col("t"), F.lit("b")).alias("two"), only_place(F.col("t"), F.lit("q")).alias("none"), window_around(F.col("t"), F.lit(3), 1).alias("w")).first()
    assert tuple(row) == (3, 1, None, None, "x\ny\nz")


def test_overlap(spark):
    make = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    got = {r.form: r.n for r in overlap.shared(make("Straße  x", "a b", None), make("STRASSE x", "ab", "a b")).collect()}
    assert got == {"exact": 1, "collapsed": 2, "squeezed": 2}
    docs, items = spark.createDataFrame([(1, "x\nline one\nline two\ny"), (2, "line one")], "doc int, text string"), spark.createDataFrame([(7, "line one\nline two")], "passage int, text string")
    assert [tuple(r) for r in overlap.contained(docs, items).collect()] == [(1, 7)]


def test_readability(spark):
    text = "# T\nOne two. Three!\n\n- item one\n```\ncode; x\n```\nlast; words"
    r = study.readability(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.chars, r.semicolons, r.sentence_n, r.max_sentence_words) == (len(text), 1, 4, 2) and r.lines == 7 and math.isclose(r.list_line_ratio, 1 / 7)
    assert spark.createDataFrame([("a; `b;` ```c;``` d;",)], "t string").select(study.loose_semicolons(F.col("t")).alias("n")).first().n == 2


def test_studies(spark):
    runs = spark.createDataFrame([("c1", "control", 10), ("c1", "treatment", 14), ("c2", "control", 8), ("c3", "control", 5), ("c3", "treatment", 5)], "case string, arm string, v int")
    pairs = study.paired(runs, ["case"], "arm", "v", "control", "treatment")
    assert {(r.case, r.delta, r.missing_arm) for r in pairs.collect()} == {("c1", 4, None), ("c2", None, "treatment"), ("c3", 0, None)}
    assert tuple(study.delta_summary(pairs).first()) == (2, 2.0, 2.0, 1)
    assert {tuple(r) for r in study.tally(pairs).collect()} == {("control", 1), ("incomplete", 1), ("tie", 1)}
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "x", 14.0), ("a", "y", 3.0)], "cond string, cell string, v double")
    assert math.isclose(study.variation(cells, ["cell"], "cond", "v").first().mean_cv, math.sqrt(8) / 12 * 100)
    ranks = spark.createDataFrame([("g", 1, 2), ("g", 2, 2), ("g", 3, 5), ("h", 1, 1), ("h", 2, 1), ("h", 3, 1), ("i", 1, 1)], "k string, x int, y int")
    assert {r.k: r.rho for r in study.spearman(ranks, "x", "y", ["k"]).collect()} == {"g": 0.866, "h": None, "i": None}
    votes = spark.createDataFrame([("1", p, "approve") for p in "abc"] + [("2", "a", "approve"), ("2", "b", "reject"), ("2", "c", "approve"), ("3", "a", "approve")], "case string, provider string, decision string")
    assert {r.case: r.approved for r in study.unanimous(votes, "case").collect()} == {"1": True, "2": False, "3": False}
    usage = spark.createDataFrame([("a", 0, 0, 0, None), ("b", 1, 1, 9, "m"), ("c", 5, 5, 10, "m")], "k string, input_tokens int, output_tokens int, total_tokens int, model string")
    assert {tuple(r) for r in study.anomalies(usage, "k").collect()} == {("a", "tokens_all_zero"), ("a", "model_missing_in_usage"), ("b", "total_much_greater_than_in_plus_out")}
    named = usage.withColumns({"prompt_tokens": F.lit(7), "completion_tokens": F.lit(8)}).withColumn("total_tokens", F.lit(None).cast("int")).withColumn("input_tokens", F.lit(None).cast("int"))
    assert study.normal_usage(named).filter("k = 'c'").select("input_tokens", "output_tokens", "total_tokens").first() == (7, 5, 12)
    assert study.mcnemar_n(0.1, 0.2) == math.ceil(((NormalDist().inv_cdf(0.975) * math.sqrt(0.3) + NormalDist().inv_cdf(0.8) * math.sqrt(0.3 - 0.01)) / 0.1) ** 2)
    assert math.isclose(study.paired_mde(100, 10.0), 2.8016, rel_tol=1e-4)


def test_rubric(spark):
    rows = [(1, 2, 2, 2, 2, False), (2, 2, 2, 1, 1, False), (3, 2, 2, 2, 0, False), (4, 1, 1, 1, 1, False), (5, 2, 2, 2, 2, True)]
    scored = study.rubric(spark.createDataFrame(rows, "k int, c1 int, c2 int, c3 int, c4 int, blocked boolean"))
    assert [(r.s, r.accept_class, r.clarity) for r in scored.orderBy("k").collect()] == [(8, study.ACCEPTED, 5), (6, study.MINOR, 4), (6, study.MAJOR, 4), (4, study.MAJOR, 3), (8, study.BLOCKED, 5)]
    s = scored.select("k", F.struct(*study.CRITERIA, "s", "blocked").alias("v"))
    pairs = s.select(F.col("k").alias("i"), F.col("v").alias("a")).crossJoin(s.select(F.col("k").alias("j"), F.col("v").alias("b")))
    got = {(r.i, r.j): r.p for r in pairs.withColumn("p", study.preference("a", "b")).collect()}
    assert (got[1, 2], got[2, 1], got[2, 3], got[3, 2], got[1, 1], got[4, 5], got[5, 4]) == ("A", "B", "A", "B", "tie", "A", "B")
    with pytest.raises(Exception, match="must be 0, 1 or 2"):
        study.rubric(spark.createDataFrame([(1, 3, 0, 0, 0, False)], "k int, c1 int, c2 int, c3 int, c4 int, blocked boolean")).collect()


CONLLU = "# text = du pain.\n1-2\tdu\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\t_\t_\t3\tcase\t_\t_\n2\tle\tle\tDET\t_\tGender=Masc|Number=Sing\t3\tdet\t_\t_\n3\tpain\tpain\tNOUN\t_\tNumber=Sing\t0\troot\t_\tSpaceAfter=No\n4\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_"


def test_parses(spark):
    df = spark.createDataFrame([("s", CONLLU)], "sent string, block string")
    w = parses.conllu_words(df).orderBy("i").collect()
    assert [(r.i, r.start, r.end, r.head) for r in w] == [(1, 0, 2, 3), (2, 0, 2, 3), (3, 3, 7, None), (4, 7, 8, 3)]
    assert [tuple(f) for f in w[1].feats] == [("Gender", "Masc"), ("Number", "Sing")] and w[3].feats == []
    assert parses.faults(parses.conllu_words(df)).count() == 0
    assert parses.faults(parses.conllu_words(spark.createDataFrame([("s", CONLLU.replace("\t3\tdet", "\t0\troot"))], "sent string, block string"))).count() == 1
    same = parses.scores(parses.aligned(parses.conllu_words(df), parses.conllu_words(df))).first()
    assert tuple(same) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    other = parses.conllu_words(spark.createDataFrame([("s", CONLLU.replace("\t3\tcase", "\t2\tcase").replace("Gender=Masc|", ""))], "sent string, block string"))
    got = parses.scores(parses.aligned(parses.conllu_words(df), other)).first()
    assert (got.uas, got.las, round(got.feats_f1, 3)) == (0.75, 0.75, 0.8)


def test_parses_are_read_where_they_lie(spark):
    line = "%s\t%s" + "\t_" * 4 + "\t0\troot\t_\t%s"
    two = "\n".join([line % ("1", "ab", "SpaceAfter=No"), line % ("2-3", "cde", "_"), line % ("2", "c", "_"), line % ("3", "de", "_"), line % ("3.1", "x", "_"), "# n", line % ("4", "é", "_")])
    got = parses.conllu_words(spark.createDataFrame([("s", CONLLU), ("t", two), ("s", CONLLU), ("u", "# none\n")], "sent string, block string").coalesce(1))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.i, r.token, r.form, r.start, r.end) for r in got.filter("sent = 't'").orderBy("i").collect()] == [(1, 1, "ab", 0, 2), (2, 2, "c", 2, 5), (3, 2, "de", 2, 5), (4, 3, "é", 6, 7)]
    assert sorted((r.i, r.token, r.start, r.end) for r in got.filter("sent = 's'").collect()) == sorted(2 * [(1, 1, 0, 2), (2, 1, 0, 2), (3, 2, 3, 7), (4, 3, 7, 8)])
    bad = lambda block: parses.conllu_words(spark.createDataFrame([("s", block)], "sent string, block string")).collect()
    with pytest.raises(Exception, match="too few fields"):
        bad("1\ta")
    with pytest.raises(Exception, match="ranges overlap"):
        bad("\n".join(line % (i, "a", "_") for i in ("1-2", "2-3", "1", "2", "3")))


def test_sides_are_compared_where_they_lie(spark):
    line = lambda i, form, lemma="l", feats="_", head="0", rel="root", misc="_": f"{i}\t{form}\t{lemma}\tX\t_\t{feats}\t{head}\t{rel}\t_\t{misc}\n"
    cut = line("2-3", "cde") + line(2, "c", head="1") + line(3, "de", feats="B|A=1", head="2")
    pairs = [
        (CONLLU, CONLLU), (CONLLU, CONLLU.replace("\t3\tcase", "\t2\tcase").replace("Gender=Masc|", "")), (CONLLU, CONLLU.replace("Gender=Masc", "Gender=Fem").replace("\t3\tpunct", "\t1\tpunct")),
        (line(1, "ab", feats="A=1|B=") + cut, line(1, "ab", feats="A=1|B", rel="dep") + line(2, "cde", head="1")), (line(1, "ab") + line(2, "cde", head="1"), line(1, "ab", lemma="m") + cut), (cut, line(1, "x")),
        (line(1, "ab", misc="SpaceAfter=No") + line(2, "c", head="9"), line(1, "abc", feats="A=1")), (line(1, "", misc="SpaceAfter=No") + line(2, "", misc="SpaceAfter=No", head="1") + line(3, "a", head="2"), line(1, "", misc="SpaceAfter=No") + line(2, "a", head="1")),
        ("# none\n", line(1, "ab")), (line(1, "ab"), None), (None, ""),
    ]
    blocks = spark.createDataFrame([(f"s{k}", *p) for k, p in enumerate(pairs)], "sent string, gold string, candidate string")
    side = lambda df, c: parses.conllu_words(df.select("sent", F.coalesce(c, F.lit("")).alias("block")))
    for df in (blocks, *(blocks.filter(F.col("sent") == f"s{k}") for k in (1, 3, 4, 7, 9))):
        assert parses.block_scores(df.coalesce(1)).first() == parses.scores(parses.aligned(side(df, "gold"), side(df, "candidate"))).first()
    assert tuple(parses.block_scores(blocks.filter("sent = 'none'")).first()) == (None,) * 6 == tuple(parses.block_scores(blocks.filter("sent = 's10'")).first())
    with pytest.raises(Exception, match="a feature twice"):
        parses.block_scores(spark.createDataFrame([("s", "", line(1, "a", feats="A=1|A=2"))], blocks.schema)).collect()


def test_feats_f1_uas_las_shuffles_no_word(spark, tmp_path):
    spark.createDataFrame([(0, "Aa bb cc dd ee ff. Gg hh"), (1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = plans.QUERIES["feats_f1_uas_las"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_vocabulary(spark):
    text = '{"entries": [%s]}'
    entry = '{"term": "%s", "part_of_speech": "%s", "meaning_id": "%s", "case_sensitive": %s}'
    entries = vocabulary.read_source(text % ", ".join(entry % e for e in [("Stop", "verb", "m1", "false"), ("stop", "noun", "m2", "false"), ("Go", "verb", "m1", "true"), ("café", "noun", "m1", "false")]))
    v = vocabulary.table(spark, entries)
    words = spark.createDataFrame([(w,) for w in ("STOP", "go", "Go", "café", "CAFÉ", "none", "Pump")], "word string")
    got = {r.word: r.status for r in vocabulary.look_up(words, v, ["pump"]).collect()}
    assert got == {"STOP": "ambiguous", "go": "missing", "Go": "matched", "café": "matched", "CAFÉ": "matched", "none": "missing", "Pump": "technical"}
    assert vocabulary.look_up(words, v, part_of_speech="noun").filter("word = 'STOP'").first().status == "matched"
    assert vocabulary.content_hash(entries) == vocabulary.content_hash(entries[::-1])
    for bad in (entry % (" a", "n", "m", "true"), entry % ("café", "n", "m", "true"), '{"term": "a", "term": "b"}', ", ".join([entry % ("a", "n", "m", "false"), entry % ("A", "n", "m", "false")])):
        with pytest.raises(ValueError):
            vocabulary.read_source(text % bad)
