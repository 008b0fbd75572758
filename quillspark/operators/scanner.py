"""Review units of documents: sentences, paragraphs, punctuation and list runs, each with its place and whether the markup
around it is certain.

Lines are rows. What a line is depends on marks before it (fences, comments, front matter), so lines are classified by one
pass over each whole text in batches; blocks, list runs and units are windows and joins over the classified lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import SPACE
from .plain import parseable

LINE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("indent", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("uncertain", T.BooleanType())])
# What makes a line structural, a list item or a quotation.
STRUCTURE = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)| {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$| {0,3}\[[^]]+\]:| {0,3}\{\{[<%].*[%>]\}\}\s*$| {0,3}</?[A-Za-z][^>]*>\s*$| {4}|\t| {0,3}(?:=+|-+)[ \t]*$|.*\|.*\|")
ITEM = re.compile(r"([ \t]*)(?:([-+*])|(\d+)[.)])[ \t]+(?=\S)")
OPEN = re.compile(r" {0,3}(`{3,}|~{3,})")
WHITE_SPLIT = re.compile(r"[^\n]*\n|[^\n]+")


def classify(text: str) -> list[tuple[int, int, str, int, str | None, bool]]:
    """(start, end, kind, indent, list family, uncertain) of each line; kind is structural, blank, list, quote or prose.
    What an unclosed fence, comment or front matter would cover is uncertain, not structural."""
    lines = [(m.start(), m.end(), m[0].rstrip("\r\n")) for m in WHITE_SPLIT.finditer(text)]
    out: list[tuple[int, int, str, int, str | None, bool]] = []
    skip, doubt = -1, False
    front = bool(lines) and lines[0][2].strip() == "---"
    for k, (a, b, line) in enumerate(lines):
        if k <= skip:
            out.append((a, b, "structural", 0, None, False))
            continue
        close = None
        if k == 0 and front:
            close = lambda x: x.strip() in ("---", "...")
        elif m := OPEN.match(line):
            tick, n = m[1][0], len(m[1])
            close = lambda x, tick=tick, n=n: bool(re.fullmatch(rf" *{re.escape(tick)}{{{n},}}\s*", x))
        elif line.lstrip().startswith("<!--"):
            close = lambda x: "-->" in x
        if close and not doubt:
            same = 0 if line.lstrip().startswith("<!--") else 1
            last = next((j for j in range(k + same, len(lines)) if close(lines[j][2])), None)
            if last is None:
                doubt = True
            else:
                skip = last
                out.append((a, b, "structural", 0, None, False))
                continue
        if not line.strip():
            out.append((a, b, "blank", 0, None, doubt))
        elif (m := ITEM.match(line)) and not re.fullmatch(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,})", line):
            out.append((a, b, "list", len(m[1].expandtabs(4)), m[2] or "number", doubt))
        elif re.match(r" {0,3}>", line):
            out.append((a, b, "quote", 0, None, doubt))
        elif STRUCTURE.match(line) and not (re.match(r" {4}|\t", line) and out and out[-1][2] in ("list", "prose")):
            out.append((a, b, "structural", 0, None, doubt))
        else:
            out.append((a, b, "prose", len(line) - len(line.lstrip()), None, doubt))
    return out


def lines(docs: DataFrame) -> DataFrame:
    """uri, k, start, end, kind, indent, family, uncertain, line."""

    @F.pandas_udf(T.ArrayType(LINE))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(classify)

    found = parseable(docs).withColumn("ls", cut("text")).select("uri", "text", F.posexplode("ls").alias("k", "l"))
    line = F.regexp_replace(F.substring("text", F.col("l.start") + 1, F.col("l.end") - F.col("l.start")), r"[\r\n]+$", "")
    return found.select("uri", "k", "l.*", line.alias("line"))


def blocks(ls: DataFrame) -> DataFrame:
    """uri, block, kind, start, end, uncertain: neighbouring lines of one kind. Blank and structural lines end a block, a
    list item begins one, and deeper prose goes on with the item before it. Blocks hold a word character."""
    w = Window.partitionBy("uri").orderBy("k")
    goes_on = (F.col("kind") == "prose") & ((F.lag("kind").over(w) == "prose") | ((F.lag("kind").over(w) == "list") & (F.col("indent") > F.lag("indent").over(w)))) | ((F.col("kind") == "quote") & (F.lag("kind").over(w) == "quote"))
    numbered = ls.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = numbered.filter(F.col("kind").isin("prose", "list", "quote")).groupBy("uri", "block")
    found = own.agg(F.min_by("kind", "k").alias("kind"), F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("end"), F.bool_or("uncertain").alias("uncertain"), F.bool_or(F.rlike("line", F.lit(r"[\p{L}\p{N}_]"))).alias("words"))
    return found.filter("words").drop("words")


def list_runs(ls: DataFrame) -> DataFrame:
    """uri, indent, family, start, end, peers: items of one indentation and family that no structural, quote or shallower
    line parts; blank lines do not. Nested lists are runs of their own. Two items or more make a run."""
    w = Window.partitionBy("uri").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = ls.withColumn("closed", F.sum(F.when(F.col("kind").isin("structural", "quote") | ((F.col("kind") == "prose") & (F.col("indent") == 0)), 1).otherwise(0)).over(w))
    items = stops.filter("kind = 'list'")
    a, b = items.alias("a"), items.select("uri", "k", "indent", "closed").alias("b")
    up = a.join(b, F.expr("a.uri = b.uri and a.closed = b.closed and b.k < a.k and b.indent < a.indent"), "left").groupBy("a.uri", "a.k", "a.start", "a.end", "a.indent", "a.family", "a.closed").agg(F.max("b.k").alias("parent"))
    runs = up.groupBy("uri", "closed", "parent", "indent", "family").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("peers"))
    return runs.filter("peers >= 2").select("uri", "indent", "family", "start", "end", "peers")


def lead_ins(runs: DataFrame, bs: DataFrame) -> DataFrame:
    """Runs with the latest block that ends before them: an as-of join as a union and a running last value."""
    marks = runs.select("uri", F.col("start").alias("at"), F.lit(1).alias("side"), F.struct("indent", "family", "start", "end", "peers").alias("run"), F.lit(None).cast("struct<start:int,end:int,kind:string>").alias("b"))
    ends = bs.select("uri", F.col("end").cast("int").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(marks.schema["run"].dataType).alias("run"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind").alias("b"))
    w = Window.partitionBy("uri").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(ends).withColumn("lead", F.last("b", ignorenulls=True).over(w)).filter("side = 1")
    return found.select("uri", "run.*", F.coalesce("lead.start", F.lit(-1)).alias("lead_in_start"), F.coalesce("lead.end", F.lit(-1)).alias("lead_in_end"), F.coalesce("lead.kind", F.lit("")).alias("lead_in_kind"))


def sentence_units(bs: DataFrame, docs: DataFrame) -> DataFrame:
    """uri, start, end, status (complete or tail), words (runs of letters), uncertain: sentences of blocks."""
    texts = bs.join(parseable(docs).select("uri", "text"), "uri").withColumn("body", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    pieces = texts.select("uri", "block", "start", "uncertain", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s).+?[.!?]+[\"')\]»”’]*(?=\s|$)|(?s).+$"), F.lit(0))).alias("k", "piece"))
    w = Window.partitionBy("uri", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("from", F.col("start") + F.sum(F.length("piece")).over(w) - F.length("piece"))
    shown = F.regexp_replace("piece", rf"^[{SPACE}]+|[{SPACE}]+$", "")
    lead = F.length("piece") - F.length(F.regexp_replace("piece", rf"^[{SPACE}]+", ""))
    status = F.when(F.rlike(shown, F.lit(r"[.!?][\"')\]»”’]*$")), "complete").otherwise("tail")
    return placed.filter(F.length(shown) > 0).select("uri", (F.col("from") + lead).alias("start"), (F.col("from") + lead + F.length(shown)).alias("end"), status.alias("status"), F.regexp_count(shown, F.lit(r"\p{L}+")).alias("words"), "uncertain")


def units(docs: DataFrame) -> DataFrame:
    """All review units: uri, unit_kind, start, end, status, uncertain, case_id (from the content's digest)."""
    ls = lines(docs)
    bs = blocks(ls)
    s = sentence_units(bs, docs).select("uri", F.lit("sentence").alias("unit_kind"), "start", "end", "status", "uncertain")
    p = bs.filter("kind = 'prose'").select("uri", F.lit("paragraph").alias("unit_kind"), "start", "end", F.lit("complete").alias("status"), "uncertain")
    semi = ls.select("uri", "kind", "uncertain", "start", F.posexplode(F.split("line", "")).alias("i", "c")).filter("c = ';'")
    status = F.when(F.col("uncertain"), "uncertain").when(F.col("kind") == "structural", "markup_or_code").otherwise("visible_prose")
    q = semi.select("uri", F.lit("punctuation").alias("unit_kind"), (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + 1).alias("end"), status.alias("status"), "uncertain")
    r = list_runs(ls).select("uri", F.lit("list").alias("unit_kind"), "start", "end", F.lit("complete").alias("status"), F.lit(False).alias("uncertain"))
    all_ = s.unionByName(p).unionByName(q).unionByName(r).join(parseable(docs).select("uri", "text"), "uri")
    digest = F.sha2(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), 256)
    case = F.concat(F.lit("unit-"), F.sha2(F.concat_ws("\0", "unit_kind", "uri", F.col("start").cast("string"), F.col("end").cast("string"), digest), 256))
    return all_.select("uri", "unit_kind", "start", "end", "status", "uncertain", digest.alias("slice_sha256"), case.alias("case_id"))


def counts(docs: DataFrame) -> DataFrame:
    """Units of each kind and status per document."""
    return units(docs).groupBy("uri").agg(*(F.count_if((F.col("unit_kind") == k) & (F.col("status") == s)).alias(n) for n, k, s in (("complete", "sentence", "complete"), ("incomplete", "sentence", "tail"), ("paragraphs", "paragraph", "complete"), ("semicolons", "punctuation", "visible_prose"), ("list_runs", "list", "complete"))))


def proposed_labels(unit_rows: DataFrame, overrides: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Labels for sentence units (with words), unless a reviewer set one: uncertain units are ambiguous, tails are out of
    scope, long sentences violate."""
    label = F.when(F.col("uncertain"), "ambiguous").when(F.col("status") != "complete", "out_of_scope").when(F.col("words") > limit, "violation").otherwise("non_violation")
    if overrides is None:
        return unit_rows.withColumn("label", label)
    return unit_rows.join(overrides.select("uri", "start", "end", F.col("label").alias("_set")), ["uri", "start", "end"], "left").withColumn("label", F.coalesce("_set", label)).drop("_set")
