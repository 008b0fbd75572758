"""The lint rules. Each takes documents (uri, text) and yields spans (uri, start, end, evidence); in doubt it stays silent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import SPACE
from ..functions.place import column_of, line_around, line_of
from . import language
from .catalog import Catalog, Context, Rule
from .markdown import mask, region_sentences, with_regions
from .intake import told_format
from .plain import long_sentences as long_spans, marks, paragraph_sentences, paragraphs, parseable, placer, simple_words, walked

LIMITS = {"procedural": 20, "descriptive": 25}
PARAGRAPH_LIMIT = 6


def format_of() -> Column:
    """The format that the suffix of a uri tells, in any case. A document of no known format fails the job."""
    unknown = F.raise_error(F.concat(F.lit("unsupported suffix: "), F.coalesce("uri", F.lit("null")))).cast("string")
    return F.coalesce(told_format(), unknown)


def of_format(docs: DataFrame, wanted: str) -> DataFrame:
    return docs.filter(format_of() == wanted)


def is_plain(docs: DataFrame) -> DataFrame:
    return of_format(docs, "plain")


def is_markdown(docs: DataFrame) -> DataFrame:
    return of_format(docs, "markdown")


def none(docs: DataFrame) -> DataFrame:
    return docs.select("uri", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("evidence")).filter(F.lit(False))


def is_full(context: Context) -> bool:
    """Whether Markdown is read by the present profile; option ``markdown_profile = "older"`` asks for the one before it."""
    return context.options.get("markdown_profile") != "older"


def long_sentences(text_type: str):
    """Complete sentences of one part with more simple words than the text type allows; documents must be declared to be of that
    type. Places and context come from the walk over the texts, and of Markdown from the sentences found only."""

    def find(docs: DataFrame, context: Context) -> DataFrame:
        if context.options.get("text_type") != text_type:
            return none(docs)
        limit = LIMITS[text_type]
        over = lambda df: df.withColumn("words", simple_words(F.col("text"))).filter(F.col("words") > limit)
        own = ("uri", "start", "end", "words", "start_line", "start_column", "end_line", "end_column", F.col("text").alias("span"), "context")
        plain = over(long_spans(is_plain(docs), limit)).withColumnsRenamed({"line": "start_line", "column": "start_column"}).select(*own)
        marked = with_regions(is_markdown(docs), is_full(context))
        found = region_sentences(marked).filter(F.col("complete") & (F.size("parts") == 1)).join(marked.select("uri", F.col("text").alias("doc")), "uri")
        found = over(found.withColumn("text", F.substring("doc", F.col("start") + 1, F.col("end") - F.col("start"))))
        places = {f"{side}_{what}": f(F.col("doc"), F.col(side).cast("int")) for side in ("start", "end") for what, f in (("line", line_of), ("column", column_of))}
        found = found.withColumns(places | {"context": line_around(F.col("doc"), F.col("start").cast("int"), F.col("end").cast("int"))}).select(*own)
        return plain.unionByName(found).withColumn("evidence", F.format_string(f"word_count=%d; limit={limit}", "words")).drop("words")

    return find


def plain_paragraphs(docs: DataFrame) -> DataFrame:
    """Long paragraphs of plain documents, with their places, from one walk over each text."""

    def each(doc: dict) -> Iterator[tuple]:
        place = placer(doc["text"])
        for start, end, n, clear in paragraph_sentences(doc["text"]):
            if clear and n > PARAGRAPH_LIMIT:
                yield start, end, n, *place(start), *place(end)

    return walked(parseable(is_plain(docs)).select("uri", "text"), "start int, end int, n int, start_line int, start_column int, end_line int, end_column int", each)


def long_paragraphs(docs: DataFrame, context: Context) -> DataFrame:
    """Paragraphs of more than six whole sentences. A paragraph with markup, an unfinished sentence, or one that crosses its
    edge is left alone. In Markdown, sentences meet paragraphs by an interval join within a document."""
    if context.options.get("text_type") != "descriptive":
        return none(docs)
    plain = plain_paragraphs(docs)
    docs = is_markdown(docs)
    marked = with_regions(docs, is_full(context))
    s = region_sentences(marked).select("uri", "start", "end", (F.col("complete") & (F.size("parts") == 1)).alias("whole")).alias("s")
    p = paragraphs(docs).alias("p")
    meet = F.expr("p.uri = s.uri and s.start < p.end and s.end > p.start")
    good = F.expr("s.whole and s.start >= p.start and s.end <= p.end")
    counted = p.join(s, meet).groupBy("p.uri", "p.start", "p.end").agg(F.count("*").alias("n"), F.bool_and(good).alias("clear"))
    counted = counted.filter(F.col("clear") & (F.col("n") > PARAGRAPH_LIMIT))
    ignored = marked.select("uri", F.inline("regions")).filter("not lintable").alias("r")
    touched = counted.alias("c").join(ignored, F.expr("c.uri = r.uri and r.start < c.end and r.end > c.start"), "left_anti").select("uri", "start", "end", "n").join(docs.select("uri", "text"), "uri")
    places = {f"{side}_{what}": f(F.col("text"), F.col(side).cast("int")) for side in ("start", "end") for what, f in (("line", line_of), ("column", column_of))}
    found = plain.unionByName(touched.withColumns(places).select(*plain.columns))
    return found.withColumn("evidence", F.format_string(f"sentence_count=%d; limit={PARAGRAPH_LIMIT}", "n")).drop("n")


def semicolons(docs: DataFrame, context: Context) -> DataFrame:
    """Semicolons in prose, with their places, from one walk over each text; in Markdown those that no markup covers."""
    full = is_full(context)
    told = parseable(docs).select("uri", "text", (format_of() == "markdown").alias("marked"))
    return marks(told, ";", lambda text: mask(text, full)).drop("ordinal", "byte_offset").withColumn("evidence", F.lit(";"))


LEAD_IN = r"(?i)(?<![\p{L}\p{N}_])these[ \t]+\p{L}+(?:-\p{L}+)*s\.$"


NEARLY = re.compile(r"these[ \t]+[^\W\d_]+(?:-[^\W\d_]+)*s\.$", re.I)  # what LEAD_IN finds, and a little more
ITEM = re.compile(r"( {0,3})(?:[-+*]|[0-9]+[.)])[ \t]+")
BLANK = np.array([ord(c) for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c)], np.uint32)


def direct_lead_ins(text: str, full: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, line without white space behind it) of the last character of lines that end with a period and stand right
    before a list, or with one blank line between. All of such a line is prose, and no sentence from before goes on in it."""
    lines = [(m.start(), m[0].rstrip("\r\n")) for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    markers = [ITEM.match(x) for _, x in lines]
    depths = [m and len(m[1]) for m in markers]
    cover = solid = None
    for k, depth in enumerate(depths[:-1]):
        if k == 0 or depth is None or depths[k + 1] != depth:
            continue
        lead = k - 1 if lines[k - 1][1].strip() else k - 2
        start, line = lines[lead] if lead >= 0 else (0, "")
        shown = line.rstrip()
        if not NEARLY.search(shown):
            continue
        if cover is None:
            cover = mask(text, full)
            solid = ~cover & ~np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), BLANK)
            seen = np.flatnonzero(solid)
        item = lambda j: depths[j] == depth and solid[lines[j][0] + markers[j].end() : lines[j][0] + len(lines[j][1])].any()  # noqa: E731, B023
        if not (item(k) and item(k + 1)) or item(k - 1) or cover[start : start + len(line)].any():
            continue
        before = np.searchsorted(seen, start + len(line) - len(line.lstrip(" \t")))
        if before == 0 or text[seen[before - 1]] in ".!?":
            yield start + len(shown) - 1, start + len(shown), shown


def list_lead_ins(docs: DataFrame, context: Context) -> DataFrame:
    """Periods of lines "... these <plural>." right before a Markdown list of two items or more.

    The lead-in is the line before the items of equal indentation, or the one before that if that is blank. It must be prose
    throughout and end a complete sentence. Each text is walked where it lies: no line or token rows are made.
    """
    full = is_full(context)
    told = parseable(is_markdown(docs)).select("uri", "text")
    lead = walked(told, "start int, end int, shown string", lambda doc: direct_lead_ins(doc["text"], full))
    return lead.filter(F.rlike("shown", F.lit(LEAD_IN))).select("uri", "start", "end", F.lit("direct-list-lead-in").alias("evidence"))


def children(parses: DataFrame) -> DataFrame:
    """Tokens with the dependencies of their children, and whether a modal auxiliary is among them. parses: uri, sentence, i, head, pos, tag, dep, start, end, text."""
    c = parses.filter("head <> i").groupBy("uri", "sentence", F.col("head").alias("i")).agg(F.collect_set("dep").alias("deps"), F.bool_or((F.col("dep") == "aux") & (F.col("tag") == "MD")).alias("modal"))
    return parses.join(c, ["uri", "sentence", "i"], "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>"))).withColumn("modal", F.coalesce("modal", F.lit(False)))


def emitted(docs: DataFrame, context: Context, rule_id: str) -> DataFrame:
    """What a language rule emits in the documents, with the words as evidence. A document's spans meet its text once."""
    found = language.emitted(language.evaluated(context.tables["sentences"], context.tables["parses"]), rule_id)
    listed = found.groupBy("uri").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(docs.select("uri", "text"), "uri")
    word = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("evidence"))
    return listed.select("uri", F.inline(F.transform("spans", word)))


def passives(docs: DataFrame, context: Context) -> DataFrame:
    """Passive verbs with an agent, or in procedures with a modal auxiliary, from the supplied parses. With sentences supplied as
    well, decisions are three-valued (``language``), and only what they emit is reported."""
    if {"parses", "sentences"} <= set(context.tables):
        return emitted(docs, context, language.VOICE)
    if "parses" not in context.tables:
        return none(docs)
    t = children(context.tables["parses"])
    has = lambda dep: F.array_contains("deps", dep)
    procedure = F.lit(context.options.get("text_type") == "procedural")
    hit = (F.col("pos") == "VERB") & (F.col("tag") == "VBN") & has("auxpass") & (has("agent") | (procedure & F.col("modal")))
    return t.filter(hit).join(docs.select("uri"), "uri", "left_semi").select("uri", "start", "end", F.col("text").alias("evidence"))


def note_imperatives(docs: DataFrame, context: Context) -> DataFrame:
    """Notes (sentences that begin with "Note:") whose only root is a base-form verb without a subject, from the parses, or by
    three-valued decisions as in ``passives``."""
    if {"parses", "sentences"} <= set(context.tables):
        return emitted(docs, context, language.NOTE)
    if "parses" not in context.tables:
        return none(docs)
    t = children(context.tables["parses"])
    roots = t.withColumn("roots", F.count_if(F.col("dep") == "ROOT").over(Window.partitionBy("uri", "sentence"))).filter("dep = 'ROOT' and roots = 1 and in_note")
    subject = F.exists("deps", lambda d: d.isin("nsubj", "nsubjpass", "csubj", "expl"))
    return roots.filter((F.col("pos") == "VERB") & F.col("tag").isin("VB", "VBP") & ~subject).join(docs.select("uri"), "uri", "left_semi").select("uri", "start", "end", F.col("text").alias("evidence"))


CATALOG = Catalog(
    [
        Rule("SEMI-001", "Semicolon in prose", "Reports semicolons outside markup.", "Semicolon in prose.", semicolons),
        Rule("SENT-001", "Procedural sentence length", "Reports procedural sentences of over 20 plain words.", "Procedural sentence is too long.", long_sentences("procedural")),
        Rule("SENT-002", "Descriptive sentence length", "Reports descriptive sentences of over 25 plain words.", "Descriptive sentence is too long.", long_sentences("descriptive")),
        Rule("PARA-001", "Descriptive paragraph length", "Reports descriptive paragraphs of over six sentences.", "Paragraph is too long.", long_paragraphs),
        Rule("LIST-001", "List lead-in", "Reports list lead-ins that end with a period.", "A list is led in by a colon.", list_lead_ins),
        Rule("PASV-001", "Passive voice", "Reports clear passives.", "Passive voice.", passives, kind="nlp"),
        Rule("NOTE-001", "Instruction in a note", "Reports notes that give an instruction.", "A note gives an instruction.", note_imperatives, kind="nlp"),
    ]
)
