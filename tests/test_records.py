"""Extraction and verification of review records."""

import json

from pyspark.sql import functions as F

from quillspark.functions import records


def test_answers(spark):
    text = 'I say {"a": 1} and then\n```json\n{"b": {"c": 2}}\n```\n'
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t string")
    got = df.select(records.greedy_object(F.col("t")).alias("g"), records.balanced_object("t").alias("b")).collect()
    assert json.loads(got[0].g) == json.loads(got[0].b) == {"b": {"c": 2}} and got[1].g == "" and got[1].b is None and got[2].b is None
    payload = json.dumps({"output": [{"type": "reasoning", "content": []}, {"type": "message", "content": [{"type": "refusal", "text": "x"}, {"type": "output_text", "text": "yes"}]}]})
    shown = spark.createDataFrame([(payload,), ('{"output": []}',)], "p string").select(records.payload_text(F.col("p")).alias("t")).collect()
    assert [r.t for r in shown] == ["yes", None]


def test_verification(spark):
    rows = [("c", "the  big pump", "clarity", "major", e, i) for i, e in enumerate(["the big", "big  pump", "the big", "small", " "])] + [("c", "x", "other", "major", "x", 9), ("c", "x", "clarity", "huge", "x", 10)]
    df = spark.createDataFrame(rows, "`case` string, text string, category string, severity string, excerpt string, seq int")
    got = [r.reason for r in records.verified(df, ["clarity"], ["major"]).orderBy("seq").collect()]
    assert got == [None, None, "duplicate", "not_verbatim", "empty_excerpt", "category", "severity"]


def test_places_and_formats(spark):
    df = spark.createDataFrame([("a b a c", ["a", "a", "c"]), ("a b", ["b", "a"]), ("a", [])], "t string, f array<string>")
    assert [r[0] for r in df.select(records.ordered_places(F.col("t"), F.col("f"))).collect()] == [[0, 4, 6], None, []]
    df = spark.createDataFrame([("2024-02-29", "a\r\nb"), ("2023-02-29", "a\rb"), ("24-1-1", "a\x0cb"), (None, None)], "d string, t string")
    assert [tuple(r) for r in df.select(records.is_iso_date(F.col("d")), records.newline_fault(F.col("t"))).collect()] == [(True, None), (False, "lone_cr"), (False, "separator"), (False, None)]
    toks = spark.createDataFrame([("use C++ or re-use C.",)], "t string").select(records.protected_tokens(F.col("t"), ["C", "C++"])).first()[0]
    assert toks == ["use", "C++", "or", "re-use", "C", "."]
    sides = records.alternating(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), "k").orderBy("k").collect()
    assert [r.control_side for r in sides] == ["A", "B", "A"]
    kept, missing = records.resumed(spark.createDataFrame([(1, True), (2, False)], "k int, valid boolean"), spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"])
    assert [r.k for r in kept.collect()] == [1] and sorted(r.k for r in missing.collect()) == [2, 3]
    s = records.normal_score(spark.createDataFrame([(9, "odd", "n" * 300)], "clarity int, accept_class string, notes string"), ["accepted"], "rejected").first()
    assert (s.clarity, s.accept_class, len(s.notes)) == (5, "rejected", 240)
