"""Plain-text parsing as expressions: regions, tokens, sentences, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import SENTENCE, SPACE, TOKEN, WORD_CHAR, leading, strip

MOST_CHARS = 1_000_000  # of a document that is parsed
MOST_ROWS, MOST_HELD = 20_000, 4_000_000  # rows of a walk, and characters in them, that a worker holds before they go on


def parseable(docs: DataFrame) -> DataFrame:
    """Documents with a null text as an empty one. One beyond the size bound fails the job: ``intake.admitted`` leaves those out
    and ``intake.problems`` tells of them. docs: uri, text."""
    text = F.coalesce("text", F.lit(""))
    too_long = F.raise_error(F.concat(F.lit(f"over {MOST_CHARS} code points: "), F.coalesce("uri", F.lit("null")))).cast("string")
    return docs.withColumn("text", F.when(F.length(text) <= MOST_CHARS, text).otherwise(too_long))


def regions(text: Column) -> Column:
    """The one lintable region of a plain text that is not empty."""
    return F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(True).alias("lintable"), F.lit("plain-text").alias("reason")))).otherwise(F.array())


def offsets(pieces: DataFrame, order: str, length: Column) -> DataFrame:
    """Start and end of pieces that follow each other without gaps: a running sum by uri."""
    w = Window.partitionBy("uri").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - length)


def token_lists(docs: DataFrame) -> DataFrame:
    """uri, text, tokens: the tokens of a document as one list."""
    return parseable(docs).select("uri", "text", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))


def tokens(docs: DataFrame) -> DataFrame:
    """uri, ordinal, start, end, text: every character lies in one token. Running lengths are summed where a document lies, so no
    token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 64):
                uris, lists = big.slice(i, 64).columns
                n, token = pc.list_value_length(lists).to_numpy(), lists.flatten()
                past = np.cumsum(pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64))
                before, first = np.concatenate([[0], past]), np.cumsum(n) - n
                ordinal = np.arange(len(token)) - np.repeat(first, n)
                base = np.repeat(before[first], n)
                uri = uris.take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([uri, pa.array(ordinal, pa.int32()), pa.array(before[:-1] - base), pa.array(past - base), token], names=["uri", "ordinal", "start", "end", "text"])

    return token_lists(docs).select("uri", "tokens").mapInArrow(run, "uri string, ordinal int, start long, end long, text string")


def walked(docs: DataFrame, schema: str, each: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that ``each`` yields of a document (a dict of its columns), behind its uri. Documents are walked where they lie, a
    batch of whole texts at a time: nothing is shuffled, and of the rows a batch of ``MOST_ROWS`` rows or ``MOST_HELD`` characters is
    held at most. ``schema`` names string, int, long and boolean columns."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [("uri", pa.string()), *((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", "))]

    texts = [c for c, (_, k) in enumerate(fields) if k == pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                doc = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                for r in each(doc):
                    rows.append(row := (doc["uri"], *r))
                    held += sum(len(row[c] or "") for c in texts)
                    if len(rows) >= MOST_ROWS or held >= MOST_HELD:
                        yield made(rows)
                        rows, held = [], 0
            yield made(rows)

    return docs.mapInArrow(run, f"uri string, {schema}")


def walked_units(units: DataFrame, docs: DataFrame, schema: str, each: Callable[[str | None, list[dict]], Iterator[tuple]]) -> DataFrame:
    """Rows that ``each(text, units)`` yields of a document, behind its uri. Units (uri, and columns that begin with start or another
    sort key) of a document meet its text once, as one ascending list, so that no text is copied; the text of a document that
    is not there is null."""
    listed = units.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct(*(c for c in units.columns if c != "uri")))).alias("units"))
    met = listed.join(docs.select("uri", F.coalesce("text", F.lit("")).alias("text")), "uri", "left")
    return walked(met.select("uri", "text", "units"), schema, lambda doc: each(doc["text"], doc["units"]))


def places(text: str, offsets: set[int]) -> dict[int, tuple[int, int]]:
    """Line and column of offsets inside a text or at its end."""
    place = placer(text)
    return {at: place(at) for at in sorted(offsets) if 0 <= at <= len(text)}


def placer(text: str) -> Callable[[int], tuple[int, int]]:
    """Line and column of offsets that do not descend from call to call."""
    line, begin, seen = 1, 0, 0  # of the place up to which line ends are counted

    def place(at: int) -> tuple[int, int]:
        nonlocal line, begin, seen
        if n := text.count("\n", seen, at):
            line, begin = line + n, text.rindex("\n", seen, at) + 1
        seen = at
        return line, at - begin + 1

    return place


SENTENCES = "ordinal int, start int, end int, text string, complete boolean, line int, column int, end_line int, end_column int"
ENDED = re.compile(SENTENCE)
APART = re.compile(rf"[{SPACE},.!?:;]+")


def sentences(docs: DataFrame) -> DataFrame:
    """uri, ordinal, start, end, text, complete, and line and column of both ends. Only . ! ? end a sentence: line ends do not,
    and the rest is incomplete."""
    return walked(parseable(docs).select("uri", "text"), SENTENCES, lambda doc: placed_sentences(doc["text"]))


def long_sentences(docs: DataFrame, over: int) -> DataFrame:
    """The complete sentences that may have more words than ``over``, with the lines around them (``context``): all that have, and
    some with fewer. The others do not leave the walk."""

    def each(doc: dict) -> Iterator[tuple]:
        text = doc["text"]
        place = placer(text)
        for ordinal, start, end, body, complete in sentence_spans(text):
            if complete and len(body) > 2 * over and len(APART.split(body)) > over:
                yield ordinal, start, end, body, complete, *place(start), *place(end), context_of(text, start, end)

    return walked(parseable(docs).select("uri", "text"), SENTENCES + ", context string", each)


def context_of(text: str, start: int, end: int) -> str:
    """The text between the line ends around a span."""
    after = text.find("\n", end)
    return text[text.rfind("\n", 0, start) + 1 : len(text) if after < 0 else after]


def sentence_spans(text: str) -> Iterator[tuple[int, int, int, str, bool]]:
    """(ordinal, start, end, text, complete) of each sentence. str.strip() knows the same white space as the expressions do."""
    for ordinal, m in enumerate(ENDED.finditer(text)):
        if body := m[0].strip():
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield ordinal, start, start + len(body), body, body[-1] in ".!?"


def placed_sentences(text: str) -> Iterator[tuple]:
    """Sentences with line and column of both ends."""
    place = placer(text)
    for s in sentence_spans(text):
        yield *s, *place(s[1]), *place(s[2])


MARKS = "ordinal int, start int, end int, byte_offset long, start_line int, start_column int, end_line int, end_column int"


def marks(docs: DataFrame, needle: str, cover: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """uri, ordinal (from 1), start, end, byte_offset and places of each occurrence of a character. Documents whose column
    ``marked`` is set are left out where ``cover(text)`` is true."""

    def each(doc: dict) -> Iterator[tuple]:
        text = doc["text"]
        at = text.find(needle)
        hidden = cover(text) if at >= 0 and cover is not None and doc.get("marked") else None
        place, ordinal, seen, before = placer(text), 0, 0, 0
        while at >= 0:
            before, seen = before + len(text[seen:at].encode()), at
            if hidden is None or not hidden[at]:
                ordinal += 1
                yield ordinal, at, at + 1, before, *place(at), *place(at + 1)
            at = text.find(needle, at + 1)

    return walked(docs, MARKS, each)


def simple_words(sentence: Column) -> Column:
    """Words of a sentence made of letters and simple punctuation only; null (abstain) if anything else is in it."""
    return F.when(~F.rlike(sentence, F.lit(rf"[^\p{{L}}{SPACE},.!?:;]")), F.size(F.regexp_extract_all(sentence, F.lit(r"\p{L}+"), F.lit(0))))


def letter_runs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}+"))


#: A token of word characters that holds a letter: what stands before its first letter has none.
WORD_WITH_LETTER = rf"(?:[\p{{N}}_]+(?:[-'][\p{{N}}_]+)*[-']?)?\p{{L}}{WORD_CHAR}*(?:[-']{WORD_CHAR}+)*"


def lintable_words(text: Column) -> Column:
    """Tokens with a letter."""
    return F.regexp_count(text, F.lit(WORD_WITH_LETTER))


PARAGRAPH_END = r"\r?\n[ \t]*\r?\n+"


def paragraphs(docs: DataFrame) -> DataFrame:
    """uri, ordinal, start, end of the trimmed paragraphs between blank lines."""
    whole = rf"(?s)(?:(?!{PARAGRAPH_END}).)+|{PARAGRAPH_END}"
    cut = parseable(docs).select("uri", F.posexplode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("ordinal", "piece"))
    placed = offsets(cut, "ordinal", F.length("piece")).withColumn("body", strip(F.col("piece"))).filter(F.length("body") > 0)
    start = F.col("start") + leading(F.col("piece"))
    return placed.select("uri", "ordinal", start.alias("start"), (start + F.length("body")).alias("end"))


PARAGRAPH_CUT = re.compile(PARAGRAPH_END)


def paragraph_sentences(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, end, sentences, clear) of each paragraph that a sentence touches; clear if all these are whole and inside it."""
    edges = [(m.start(), m.end()) for m in PARAGRAPH_CUT.finditer(text)]
    begins, ends = [0, *(b for _, b in edges)], [*(a for a, _ in edges), len(text)]
    spans = [(a, b, whole) for _, a, b, _, whole in sentence_spans(text)]
    first = 0
    for a, b in zip(begins, ends):
        if body := text[a:b].strip():
            start = a + len(text[a:b]) - len(text[a:b].lstrip())
            end = start + len(body)
            while first < len(spans) and spans[first][1] <= start:
                first += 1
            k, clear = first, True
            while k < len(spans) and spans[k][0] < end:
                clear &= spans[k][2] and spans[k][0] >= start and spans[k][1] <= end
                k += 1
            if k > first:
                yield start, end, k - first, clear


def token_faults(docs: DataFrame) -> DataFrame:
    """Documents whose tokens, joined, are not their text: what ``partition_faults`` finds of ``tokens``, with no row for each token."""
    return token_lists(docs).filter(F.array_join("tokens", "") != F.col("text")).select("uri")


def partition_faults(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose pieces (uri, start, end) leave a gap, overlap or miss the end."""
    w = Window.partitionBy("uri").orderBy("start")
    marked = pieces.withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)))
    sums = marked.groupBy("uri").agg(F.bool_or("gap").alias("gap"), F.max("end").alias("last"))
    return parseable(docs).join(sums, "uri", "left").filter(F.coalesce("gap", F.lit(False)) | (F.coalesce("last", F.lit(0)) != F.length("text"))).select("uri")
