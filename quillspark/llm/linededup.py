"""Substring dedup by hashing of lines and of the units inside them.

Lines with a word are hashed whole, whatever their length. A line is also cut into units after punctuation followed by white
space, so that a passage pasted into the middle of a line still falls into the same units. A unit is normalised (ASCII
lower case, single spaces, none at its ends; stops stay, so a question is no copy of an exclamation) and hashed to 128 bits; one of under ``min_unit_words`` words is hashed together with the
unit before it and with the one behind it, since alone it says too little. Digests are grouped over the whole corpus; the
earliest occurrence by (id, position) stays.

Later occurrences of whole lines are removed. Later occurrences of units are removed where they stand in an unbroken run
with others or with such lines and the run has ``min_span_words`` words or more, so that a short phrase inside a line stays.
Nothing else goes: a run ends at any unit that is not a later occurrence. Removed neighbours are one span, with its offsets
in the original text.

Counts are formed before the shuffle, and only digests that occur twice or more are written. The second pass over the texts
lets through, by a bitmap of bounded size, little more than their occurrences; a line found in a third of all documents is a
skewed key of that join alone, which is split because both sides are shuffled as they are.

Defined cases: null and empty texts have no units; rows with the same id are told apart by nothing, so an equal unit at an
equal place in both counts as one occurrence and stays in both; a null id ranks first; an empty table gives no spans;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BOOL, INT, LONG, bitmap, give_back, in_bitmap, quoted, schema, spread, written

#: Where a unit ends: punctuation before white space, or a line end.
BOUNDARY = re.compile(r"[.,;:!?](?=[\x20\x09-\x0D])|\n")
ODD_SPACE = re.compile(r"[\x09\x0B-\x0D]|\x20\x20")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WHITE_CHARS, EDGE = " \t\n\x0b\x0c\r", ".,;:!?"


def units(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, end, words, normalised text, line) of each unit with a word; offsets are code points and leave outer white space
    out."""
    low = text.encode().lower().decode()  # ASCII letters only, so offsets stay
    odd, out, at, line = ODD_SPACE.search(low) is not None, [], 0, 0
    for end in [*(m.end() for m in BOUNDARY.finditer(low)), len(low)]:
        piece = low[at:end]
        body = piece.strip(WHITE_CHARS)
        norm = SPACES.sub(" ", body) if odd else body
        if norm.strip(" .,;:!?"):
            a = at + piece.index(body[0])
            out.append((a, a + len(body), norm.count(" ") + 1, norm, line))
        line += piece.endswith("\n")
        at = end
    return out


def marks(text: str, min_unit_words: int) -> Iterator[tuple[int, int, int, int, int, bool, str]]:
    """(first unit, last unit, start, end, words, whether a whole line, what is hashed) of all that is compared in a text."""
    found = units(text)
    k = 0
    while k < len(found):
        j = k + 1
        while j < len(found) and found[j][4] == found[k][4]:
            j += 1
        own = found[k:j]
        yield k, j - 1, own[0][0], own[-1][1], sum(u[2] for u in own), True, own[0][3] if j - k == 1 else "\n".join(u[3] for u in own)
        for i in range(k, j) if j - k > 1 else ():
            a, b, n, norm, _ = found[i]
            if n >= min_unit_words:
                yield i, i, a, b, n, False, norm
            else:
                if i:
                    yield i, i, a, b, n, False, f"<{found[i - 1][3]}\n{norm}"
                if i + 1 < len(found):
                    yield i, i, a, b, n, False, f">{norm}\n{found[i + 1][3]}"
        k = j


MARK = schema(id=LONG, first=INT, last=INT, start=INT, end=INT, words=INT, whole=BOOL, hi=LONG, lo=LONG)
MARK_ARROW = [pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.int64(), pa.int64()]


def marked(docs: DataFrame, id_col: str, text_col: str, min_unit_words: int, wanted: np.ndarray | None = None) -> DataFrame:
    """A row per mark of a text, or of those whose digest is in the bitmap ``wanted``."""
    kept = spread(docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")))
    bits = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def made(rows: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
        digest = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, MARK_ARROW)] + [pa.array(digest[:, 0]), pa.array(digest[:, 1])]
        batch = pa.RecordBatch.from_arrays(columns, names=MARK.names)
        return batch if bits is None else batch.filter(pa.array(in_bitmap(bits.value, digest[:, 0])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for *mark, said in marks(text.as_py(), min_unit_words):
                    rows.append((id_, *mark))
                    digests.append(xxhash.xxh3_128_digest(said))
                if len(rows) >= 20_000:
                    yield made(rows, digests)
                    rows, digests = [], []
            yield made(rows, digests)
            give_back()

    return kept.mapInArrow(cut, MARK)


def spans_of(found: Iterable[tuple], min_span_words: int) -> Iterator[list]:
    """The removed spans [start, end, words, units, first_id, last unit] of one text, from its later occurrences (first unit, last
    unit, start, end, words, whole line, first_id) in the order of first unit, then longest."""
    run: list | None = None
    lines: list[list] = []

    def ended() -> list[list]:
        return [] if run is None else [run] if run[2] >= min_span_words else lines

    def longer(to: list, by: list) -> None:
        to[1], to[2], to[3], to[5] = by[1], to[2] + by[2], to[3] + by[3], by[5]

    for first, last, start, end, words, whole, first_id in found:
        if run and last <= run[5]:  # inside a line that is gone already, or a short unit's second mark
            continue
        new = [start, end, words, last - first + 1, first_id, last]
        if run and first == run[5] + 1:
            longer(run, new)
        else:
            yield from ended()
            run, lines = list(new), []
        if whole:
            if lines and first == lines[-1][5] + 1:
                longer(lines[-1], new)
            else:
                lines.append(new)
    yield from ended()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_unit_words: int = 3, min_span_words: int = 20) -> DataFrame:
    """A row per removed span: id, start, end (code points, end exclusive), words, units, first_id (where its first unit stays)."""
    place = F.struct(F.col("id"), F.col("first"))
    groups = marked(docs, id_col, text_col, min_unit_words).groupBy("hi", "lo").agg(F.min(place).alias("stays"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select("hi", "lo", "stays"), "repeated")
    rows = marked(docs, id_col, text_col, min_unit_words, bitmap(groups.select(F.col("hi").alias("h"))))
    hits = rows.join(groups, ["hi", "lo"]).filter(~place.eqNullSafe(F.col("stays")))
    mark = F.struct("first", (-F.col("last")).alias("order"), ~F.col("whole"), "last", "start", "end", "words", "whole", F.col("stays.id").alias("first_id"))
    found = hits.select("id", mark.alias("mark")).groupBy("id").agg(F.sort_array(F.collect_list("mark")).alias("found"))
    kinds = (pa.int64(), *[pa.int32()] * 4, pa.int64())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            flat = batch.column(1).flatten()
            rows = zip(*(flat.field(c).to_pylist() for c in ("first", "last", "start", "end", "words", "whole", "first_id")))
            for id_, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist()):
                out += [(id_, *r[:5]) for r in spans_of(islice(rows, n), min_span_words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["id", "start", "end", "words", "units", "first_id"])

    return found.mapInArrow(merged, schema(id=LONG, start=INT, end=INT, words=INT, units=INT, first_id=LONG))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the spans' code points cut out; all columns stay. Texts travel once, spans as a list a document."""
    cuts = spans.groupBy(F.col("id").alias("_cut_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    kept = docs.join(cuts, quoted(id_col).eqNullSafe(F.col("_cut_id")), "left")
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda i: F.substring(
            quoted(text_col),
            F.when(i == 0, 1).otherwise(F.col("_cuts")[F.greatest(i - 1, F.lit(0))]["end"] + 1),
            F.when(i == F.size("_cuts"), F.length(quoted(text_col))).otherwise(F.col("_cuts")[F.least(i, F.size("_cuts") - 1)]["start"]) - F.when(i == 0, 0).otherwise(F.col("_cuts")[F.greatest(i - 1, F.lit(0))]["end"]),
        ),
    )
    return kept.withColumn(text_col, F.when(F.col("_cuts").isNull(), quoted(text_col)).otherwise(F.array_join(parts, ""))).drop("_cut_id", "_cuts")
