"""Offset cases: analysed segments of a text, their surface tokens and syntactic words, what is left out, and checks of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import SPACE
from ..functions.records import ordered_places, protected_tokens
from .plain import walked_units

STATUS_PENDING, STATUS_APPROVED, ROLE = "pending-model-panel", "model-panel-approved", "three-model-panel"
MARKUP, PARTIAL = "structural-markup", "partial-structural-markup"


def segments(cases: DataFrame) -> DataFrame:
    """uri, segment, start, end: the fragments of each case (uri, text, fragments) where they lie one after another. A fragment
    that is not found behind the one before fails the job."""
    at = ordered_places(F.col("text"), F.col("fragments"))
    lost = F.raise_error(F.concat(F.lit("fragment not found in order: "), F.col("uri"))).cast("array<int>")
    found = cases.withColumn("at", F.coalesce(at, lost)).select("uri", "fragments", F.posexplode("at").alias("segment", "start"))
    return found.select("uri", "segment", "start", (F.col("start") + F.length(F.get("fragments", F.col("segment")))).alias("end"))


def surface_tokens(cases: DataFrame, forms: list[str] = ()) -> DataFrame:
    """uri, token, segment, start, end, text: tokens of the segments in order, protected forms whole. ``token`` counts from 0
    in a case. A fragment holds its own tokens, so the texts stay where they are."""
    at = ordered_places(F.col("text"), F.col("fragments"))
    parts = cases.select("uri", F.posexplode(F.arrays_zip(at.alias("start"), F.col("fragments").alias("body"))).alias("segment", "x"))
    # pieces: tokens and the white space between them, so that running lengths are places
    cut = parts.select("uri", "segment", F.col("x.start").alias("base"), F.posexplode(pieces(F.col("x.body"), forms)).alias("k", "piece"))
    own = Window.partitionBy("uri", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("end", F.col("base") + F.sum(F.length("piece")).over(own)).filter(~F.rlike("piece", F.lit(rf"^[{SPACE}]+$")))
    number = F.row_number().over(Window.partitionBy("uri").orderBy("segment", "k")) - 1
    return placed.select("uri", number.alias("token"), "segment", (F.col("end") - F.length("piece")).alias("start"), "end", F.col("piece").alias("text"))


def pieces(body: Column, forms: list[str]) -> Column:
    """A text cut into protected tokens and runs of white space."""
    tokens = protected_tokens(body, list(forms))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def go(acc: Column, t: Column) -> Column:
        place = F.position(t, body, acc["at"])
        gap = F.substring(body, acc["at"], place - acc["at"])
        return F.struct((place + F.length(t)).alias("at"), F.concat(acc["out"], F.filter(F.array(gap, t), lambda x: x != "")).alias("out"))

    return F.aggregate(tokens, start, go, lambda acc: acc["out"])


def syntactic_words(tokens: DataFrame, expansions: dict[str, list[str]]) -> DataFrame:
    """uri, word, token, form: a surface token is one word, or those that it stands for."""
    known = F.create_map(*(x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if expansions else F.lit(None).cast("map<string,array<string>>")
    rows = tokens.select("uri", "token", F.posexplode(F.coalesce(F.try_element_at(known, F.col("text")), F.array("text"))).alias("j", "form"))
    return rows.select("uri", (F.row_number().over(Window.partitionBy("uri").orderBy("token", "j")) - 1).alias("word"), "token", "form")


def sentence_spans(tokens: DataFrame) -> DataFrame:
    """uri, segment, start, end, first_token, past_last_token of the segments that have tokens."""
    return tokens.groupBy("uri", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("token").alias("first_token"), (F.max("token") + 1).alias("past_last_token"))


def abstentions(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """uri, start, end, reason: gaps before, between and behind the segments of a case that hold more than white space."""
    listed = spans.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    met = cases.select("uri", "text").join(listed, "uri", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    gaps = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda g: (g["start"] < g["end"]) & F.rlike(F.substring("text", g["start"] + 1, g["end"] - g["start"]), F.lit(rf"[^{SPACE}]")))
    return met.select("uri", F.inline(gaps)).withColumn("reason", F.lit(MARKUP))


def sweep(spans: DataFrame, lengths: DataFrame, kinds: list[str]) -> DataFrame:
    """Faults of spans (uri, kind, start, end) against the texts' lengths (uri, length), a row a fault: uri, start, end, fault.
    "invalid" lies outside or is empty, "overlap" begins before a span of its kind has ended, "crossing" before one of another
    kind has. Spans are swept once in order of their starts, with the furthest end so far of each kind; a kind that is not
    among ``kinds`` fails the job."""
    known = spans.join(lengths, "uri", "left").withColumn("ok", F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length")), F.lit(False)))
    other = F.raise_error(F.concat(F.lit("no such kind: "), F.coalesce("kind", F.lit("null")))).cast("string")
    good = known.filter("ok").withColumn("kind", F.when(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), F.col("kind")).otherwise(other))
    before = Window.partitionBy("uri").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    reach = good.withColumns({f"reach{i}": F.coalesce(F.max(F.when(F.col("kind") == k, F.col("end"))).over(before) > F.col("start"), F.lit(False)) for i, k in enumerate(kinds)})
    own = reduce(lambda a, b: a | b, (F.col(f"reach{i}") & (F.col("kind") == k) for i, k in enumerate(kinds)))
    others = reduce(lambda a, b: a | b, (F.col(f"reach{i}") & (F.col("kind") != k) for i, k in enumerate(kinds)))
    faults = reach.select("uri", "start", "end", F.explode(F.array_compact(F.array(F.when(own, "overlap"), F.when(others, "crossing")))).alias("fault"))
    return faults.unionByName(known.filter("not ok").select("uri", "start", "end", F.lit("invalid").alias("fault")))


def case_faults(cases: DataFrame, spans: DataFrame, tokens: DataFrame, sentences: DataFrame, words: DataFrame, left_out: DataFrame) -> DataFrame:
    """uri, fault, n of cases whose parts do not fit: spans by ``sweep``, tokens that overlap or leave their segment, sentences that
    do not begin and end with their tokens, words without a token, tokens whose slice is another text."""
    lengths = cases.select("uri", F.length("text").alias("length"))
    kinds = [s.select("uri", F.lit(k).alias("kind"), "start", "end") for s, k in ((spans, "analysis"), (left_out, "abstention"))]
    swept = sweep(kinds[0].unionByName(kinds[1]), lengths, ["analysis", "abstention"]).select("uri", F.concat(F.lit("span_"), "fault").alias("fault"))
    gap = Window.partitionBy("uri").orderBy("token")
    late = tokens.withColumn("before", F.lag("end").over(gap)).filter("before > start").select("uri", F.lit("token_overlap").alias("fault"))
    home = spans.select("uri", "segment", F.col("start").alias("a"), F.col("end").alias("b"))
    astray = tokens.join(home, ["uri", "segment"], "left").filter("a is null or start < a or end > b or start >= end").select("uri", F.lit("token_outside").alias("fault"))
    edge = tokens.groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("start", "end")))).alias("at"))
    s = sentences.join(edge, "uri", "left")
    first, last = F.try_element_at("at", F.col("first_token")), F.try_element_at("at", F.col("past_last_token") - 1)
    loose = s.filter(~F.coalesce((F.col("first_token") < F.col("past_last_token")) & (first["start"] == F.col("start")) & (last["end"] == F.col("end")), F.lit(False))).select("uri", F.lit("sentence_edges").alias("fault"))
    orphan = words.join(tokens.select("uri", "token"), ["uri", "token"], "left_anti").select("uri", F.lit("orphan_word").alias("fault"))
    shown = tokens.select("uri", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").alias("shown"))
    wrong = walked_units(shown, cases, "fault string", lambda text, ts: (("token_slice",) for t in ts if text is None or text[max(t["start"], 0) : t["end"]] != t["shown"]))
    all_ = swept
    for part in (late, astray, loose, orphan, wrong):
        all_ = all_.unionByName(part)
    return all_.groupBy("uri", "fault").agg(F.count("*").alias("n"))


def abstention_reason(cases: DataFrame, spans: DataFrame, left_out: DataFrame) -> DataFrame:
    """uri, abstention_reason: null if all of a case is analysed, else whether all or part of it is left out."""
    n = lambda df, name: df.groupBy("uri").agg(F.count("*").alias(name))
    met = cases.select("uri").join(n(spans, "s"), "uri", "left").join(n(left_out, "a"), "uri", "left")
    return met.select("uri", F.when(F.col("a") > 0, F.when(F.coalesce("s", F.lit(0)) == 0, MARKUP).otherwise(PARTIAL)).alias("abstention_reason"))


def word_ranges(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Sentences with the words of their tokens: first_word, past_last_word."""
    w = words.alias("w").join(sentences.alias("s"), F.expr("w.uri = s.uri and w.token >= s.first_token and w.token < s.past_last_token"))
    found = w.groupBy("s.uri", "s.segment").agg(F.min("w.word").alias("first_word"), (F.max("w.word") + 1).alias("past_last_word"))
    return sentences.join(found, ["uri", "segment"], "left")


def frozen(cases: DataFrame, votes: DataFrame, panel: dict[str, str], reviewed_on: str) -> DataFrame:
    """Cases (case_id, ...) that every provider of the panel approved, with who reviewed them and how; others fail the job.
    votes: case_id, provider, decision."""
    counted = votes.filter(F.col("provider").isin(*panel)).groupBy("case_id").agg(F.count_distinct(F.when(F.col("decision") == "approve", F.col("provider"))).alias("_for"), F.count_if(F.col("decision") != "approve").alias("_against"))
    met = cases.join(counted, "case_id", "left")
    fine = F.coalesce((F.col("_for") == len(panel)) & (F.col("_against") == 0), F.lit(False))
    status = F.when(fine, STATUS_APPROVED).otherwise(F.raise_error(F.concat(F.lit("not unanimous: "), F.col("case_id"))).cast("string"))
    by = ";".join(f"{k}:{v}" for k, v in panel.items())
    return met.withColumns({"review_status": status, "reviewed_by": F.lit(by), "reviewer_role": F.lit(ROLE), "reviewed_on": F.lit(reviewed_on)}).drop("_for", "_against")
