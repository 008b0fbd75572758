"""Three-valued rules over parsed sentences: a sentence is clear, emits spans, or abstains for a reason.

Sentences (uri, sentence, start, end, complete, parts, text_type) are admitted if they are complete, lie in one part of the
text and have a parse. Parses (uri, sentence, i, head, pos, tag, dep, start, end) are token rows, offsets count from the
start of the sentence, and a root is its own head. Both rules come out of one pass: tokens are dealt by sentence once, what a
token's children are and what a sentence holds are counted there, and decisions are expressions over those counts.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plain import walked

VOICE, NOTE = "PASV-001", "NOTE-001"
CLEAR, EMIT, ABSTAIN = "clear", "emit", "abstain"
# Text types that the voice rule knows, and dependencies that make a subject.
TEXT_TYPES = ("procedural", "descriptive", "procedural-note")
SUBJECTS = ("nsubj", "nsubjpass", "expl")
SPANS = "array<struct<start:int,end:int>>"


def sentence_facts(parses: DataFrame) -> DataFrame:
    """A row per parsed sentence: its tokens, verbs and roots, its passive candidates and the spans that confirm them."""
    dealt = parses.repartition("uri", "sentence")  # both groupings below start with these keys: no further shuffle
    child = dealt.filter("head <> i").groupBy("uri", "sentence", F.col("head").alias("i")).agg(
        F.bool_or(F.col("dep") == "auxpass").alias("passive"), F.bool_or(F.col("dep") == "agent").alias("agent"),
        F.bool_or((F.col("dep") == "aux") & (F.col("tag") == "MD")).alias("modal"), F.bool_or(F.col("dep").isin(*SUBJECTS)).alias("subject"),
    )
    t = dealt.join(child, ["uri", "sentence", "i"], "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    candidate = (F.col("pos") == "VERB") & (F.col("tag") == "VBN") & has("passive")
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    spans = lambda where: F.sort_array(F.collect_list(F.when(where, span)))
    root = F.col("dep") == "ROOT"
    return t.groupBy("uri", "sentence").agg(
        F.count("*").alias("tokens"), F.max("end").alias("reach"), F.count_if(candidate).alias("candidates"), spans(candidate & has("agent")).alias("with_agent"),
        spans(candidate & (has("agent") | has("modal"))).alias("with_modal"), F.count_if(root).alias("roots"), F.count_if(F.col("pos").isin("VERB", "AUX")).alias("verbs"),
        F.max(F.when(root, F.struct("pos", "tag", has("subject").alias("subject"), span.alias("span")))).alias("root"),
    )


FACTS = "reach int, candidates int, with_agent string, with_modal string, roots int, verbs int, root_pos string, root_tag string, root_subject boolean, root_start int, root_end int"
Token = namedtuple("Token", "i head pos tag dep start end")


def told_facts(tokens: list[Token]) -> tuple:
    """FACTS of the parse of one sentence."""
    kids: dict[int, set[str]] = {}
    for t in tokens:
        if t.head != t.i:
            kids.setdefault(t.head, set()).update((t.dep, "modal") if t.dep == "aux" and t.tag == "MD" else (t.dep,))
    none: set[str] = set()
    has = lambda t: kids.get(t.i, none)
    passive = [t for t in tokens if t.tag == "VBN" and t.pos == "VERB" and "auxpass" in has(t)]
    spans = lambda ts: ",".join(f"{a}:{b}" for a, b in sorted((t.start, t.end) for t in ts))
    roots = [(t.pos, t.tag, not has(t).isdisjoint(SUBJECTS), t.start, t.end) for t in tokens if t.dep == "ROOT"]
    return (
        max(t.end for t in tokens), len(passive), spans(t for t in passive if "agent" in has(t)), spans(t for t in passive if not has(t).isdisjoint(("agent", "modal"))),
        len(roots), sum(t.pos in ("VERB", "AUX") for t in tokens), *max(roots, default=(None,) * 5),
    )


def parsed(docs: DataFrame, schema: str, parse: Callable[[dict], Iterator[tuple[tuple, list[Token]]]]) -> DataFrame:
    """Sentence rows for ``decisions``: ``parse`` yields the values of ``schema`` (sentence, start, end, complete, parts, text_type)
    and the tokens of each sentence of a document. Documents are parsed where they lie; of a parse only its facts go on, so
    that no token is a row or is shuffled."""
    nothing = (None,) * len(FACTS.split(", "))
    rows = walked(docs, f"{schema}, tokens int, {FACTS}", lambda doc: ((*s, len(ts) or None, *(told_facts(ts) if ts else nothing)) for s, ts in parse(doc)))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: span(F.substring_index(x, ":", 1), F.substring_index(x, ":", -1)))
    root = F.when(F.col("roots") > 0, F.struct(F.col("root_pos").alias("pos"), F.col("root_tag").alias("tag"), F.col("root_subject").alias("subject"), span(F.col("root_start"), F.col("root_end")).alias("span")))
    return rows.withColumns({"with_agent": spans("with_agent"), "with_modal": spans("with_modal"), "root": root})


def decided(decision: str, reason: str = "", findings: Column | None = None) -> Column:
    found = F.array().cast(SPANS) if findings is None else findings
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), found.alias("findings"))


def evaluated(sentences: DataFrame, parses: DataFrame) -> DataFrame:
    """uri, sentence, rule_id, decision, reason, findings (offsets in the text): two rows a sentence, one a rule.

    A parse that reaches beyond its sentence is of another text and fails the job. Only a decision that emits has findings.
    """
    return decisions(sentences.join(sentence_facts(parses), ["uri", "sentence"], "left"))


def decisions(s: DataFrame) -> DataFrame:
    """What ``evaluated`` returns, of sentences that have the facts of their parses beside them."""
    other = F.raise_error(F.concat(F.lit("parse of another text: "), F.col("uri"))).cast("long")
    s = s.withColumn("tokens", F.when(F.col("reach") > F.col("end") - F.col("start"), other).otherwise(F.col("tokens")))

    def admitted(rest: Column) -> Column:
        return (
            F.when(~F.col("complete"), decided(ABSTAIN, "incomplete")).when(F.col("parts") != 1, decided(ABSTAIN, "several_parts"))
            .when(F.col("tokens").isNull(), decided(ABSTAIN, "no_parse")).otherwise(rest)
        )

    passive = F.when(F.col("text_type") == "procedural", F.col("with_modal")).otherwise(F.col("with_agent"))
    voice = F.when(F.size(passive) > 0, decided(EMIT, "", passive)).when(F.col("candidates") > 0, decided(ABSTAIN, "unconfirmed")).otherwise(decided(CLEAR))
    voice = F.when(F.coalesce(F.col("text_type").isin(*TEXT_TYPES), F.lit(False)), admitted(voice)).otherwise(decided(ABSTAIN, "undeclared"))

    verb, present = F.col("root.pos") == "VERB", F.col("root.tag") == "VBP"
    command = verb & F.col("root.tag").isin("VB", "VBP") & ~F.col("root.subject")
    note = (
        F.when(F.col("roots") != 1, decided(ABSTAIN, "roots")).when(command, decided(EMIT, "", F.array("root.span")))
        .when(verb & present, decided(ABSTAIN, "subject")).when(F.col("verbs") == 0, decided(ABSTAIN, "no_verb")).otherwise(decided(CLEAR))
    )
    note = F.when(F.coalesce(F.col("text_type") == "procedural-note", F.lit(False)), admitted(note)).otherwise(decided(CLEAR, "not_a_note"))

    both = F.array(*(F.struct(F.lit(r).alias("rule_id"), d.alias("d")) for r, d in ((VOICE, voice), (NOTE, note))))
    rows = s.select("uri", "sentence", "start", F.inline(both))
    base = lambda x: F.struct((F.col("start") + x["start"]).cast("int").alias("start"), (F.col("start") + x["end"]).cast("int").alias("end"))
    return rows.select("uri", "sentence", "rule_id", "d.decision", "d.reason", F.transform("d.findings", base).alias("findings"))


def histogram(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sentences by rule, decision and reason."""
    return decisions.groupBy(*(by or []), "rule_id", "decision", "reason").agg(F.count("*").alias("sentences"))


def emitted(decisions: DataFrame, rule_id: str) -> DataFrame:
    """uri, start, end of what a rule emits."""
    return decisions.filter(F.col("rule_id") == rule_id).select("uri", F.inline("findings"))
