"""Secret scan: fixed patterns, and zstandard novelty of strings that stand in a sensitive context.

``scan_secrets`` reads whole texts, a batch at a time, and returns a row per document with its spans. A span has a kind,
code-point offsets (end exclusive) and, for the kind ``novel``, the marginal compressed bytes that reported it.

The method: a candidate is a long unbroken run of key characters that lies, in part at least, within ``reach`` code points of
a sensitive word, before or behind it. It is compressed against two primed zstandard dictionaries: common identifiers with
the code or prose around the candidate, and the common long words of the whole corpus. What these explain (an identifier, a
name used nearby, a word) costs next to nothing; a secret costs about its own length. A word of the corpus is one that is
found outside of sensitive contexts, so a secret that many documents repeat does not become one. Copies of the candidate that stand in
a sensitive context themselves are left out of the surroundings, so a secret used twice does not explain itself. A candidate
whose marginal bytes a character reach ``min_ratio`` is reported, whatever characters it is made of. Base patterns always
stay; a candidate that overlaps one is not measured.

A text takes time in proportion to its length: each run is measured once, and novel spans never overlap.

Defined cases: a null or empty text has no spans; null ids are kept; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, STR, quoted, schema, spread

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same as all runs of which the short ones are dropped
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|bearer|credential|private[_-]?key|signature|access[_-]?key)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~](?:[A-Za-z0-9+/_=.~-]*[A-Za-z0-9+/_=~])?")
LONG_WORD = re.compile(r"[A-Za-z]{12,}")
#: Prefilters of whole columns: documents without a match have no span of that kind.
MAY_ASSIGN, MAY_HEX, MAY_SENSE = r"(?i)(password|passwd|secret|token|api_?key)", r"[0-9a-f]{32}", r"(?i)(pass|pwd|secret|token|api[_-]?key|auth|bearer|credential|private|signature|access)"
KINDS = ("assign", "access", "hex", "novel")
#: Identifiers that code and configuration are full of; they prime the dictionary.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key authorization bearer credential username client_id "
    "client_secret localhost example placeholder changeme undefined function return import export const string default "
    "config settings environment database connection session request response application/json https://www. http:// .com "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 get_value set_value user_name file_name created_at"
)
SPAN = T.StructType([T.StructField("kind", STR), T.StructField("start", INT), T.StructField("end", INT), T.StructField("cost", DBL)])


@dataclass(frozen=True)
class Novelty:
    """reach: code points between a sensitive word and a candidate. around: context on either side that primes the dictionary.
    min_length: of a candidate. min_ratio: marginal compressed bytes a character. min_bytes: marginal bytes in all.
    common_words: how many words of the corpus prime the other dictionary, from those of min_documents documents or more."""

    reach: int = 48
    around: int = 1024
    min_length: int = 12
    min_ratio: float = 0.6
    min_bytes: int = 10
    common_words: int = 4096
    min_documents: int = 3


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def packer(primer: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(candidate: str, around: str, common: zstandard.ZstdCompressor | None = None) -> int:
    """What the candidate adds to a frame whose dictionary is the identifiers and the text around, or the common words."""
    cost = lambda p: len(p.compress(candidate.encode())) - len(p.compress(b""))
    own = cost(packer(IDENTIFIERS + "\n" + around))
    return own if common is None else min(own, cost(common))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def overlapping(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """For each of the sorted disjoint spans, whether one of the sorted disjoint others overlaps it: one walk over both."""
    out, k = [], 0
    for a, b in spans:
        while k < len(others) and others[k][1] <= a:
            k += 1
        out.append(k < len(others) and others[k][0] < b)
    return out


def sensitive_zones(text: str, reach: int) -> list[tuple[int, int]]:
    """Places within reach of a sensitive word."""
    return united([(m.start() - reach, m.end() + reach) for m in SENSITIVE.finditer(text)])


def novel_spans(text: str, taken: list[tuple[int, int, int]], how: Novelty, common: zstandard.ZstdCompressor | None = None) -> list[tuple[int, int, int, float]]:
    """Candidates that no base span overlaps and that their surroundings don't explain."""
    zones = sensitive_zones(text, how.reach)
    runs = [m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= how.min_length]
    runs = [x for x, near in zip(runs, overlapping(runs, zones)) if near]
    free = overlapping(runs, united([(a, b) for a, _, b in taken]))
    copies: dict[str, list[int]] = {}
    for a, b in runs:
        copies.setdefault(text[a:b], []).append(a)
    out = []
    for (a, b), hit in zip(runs, free):
        if hit:
            continue
        s, lo, hi = text[a:b], max(0, a - how.around), b + how.around
        pieces, at = [], lo
        own = copies[s]
        for c in own[bisect_left(own, lo) :]:
            if c >= hi:
                break
            pieces.append(text[at:c])
            at = c + len(s)
        cost = marginal_bytes(s, " ".join([*pieces, text[at:hi]]), common)
        if cost >= how.min_bytes and cost >= how.min_ratio * len(s):
            out.append((a, 3, b, float(cost)))
    return out


def common_words(texts: DataFrame, how: Novelty) -> list[str]:
    """Long words of the corpus by the number of texts that hold them outside of sensitive contexts: at most ``common_words`` of
    them, read over all texts. What stands in such contexts only is no word, however often it is copied."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text, may in zip(batch.column(0).to_pylist(), pc.match_substring_regex(batch.column(0), MAY_SENSE).to_pylist()):
                zones = sensitive_zones(text, how.reach) if may else []
                if zones:
                    found = list(LONG_WORD.finditer(text))
                    near = overlapping([m.span() for m in found], zones)
                    seen.update({m[0] for m, hidden in zip(found, near) if not hidden})
                else:
                    seen.update(set(LONG_WORD.findall(text)))
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = texts.select("text").mapInArrow(count, schema(word=STR, n=LONG)).groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.filter(F.col("n") >= how.min_documents).orderBy(F.desc("n"), "word").limit(how.common_words).collect()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Novelty = Novelty()) -> DataFrame:
    """(id, spans): spans by start, then kind in the order of KINDS."""
    kept = spread(docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")))

    words = "\n".join(common_words(kept, how))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = packer(words) if len(words) >= 8 else None
        for batch in batches:
            texts = batch.column(1)
            may = [pc.match_substring_regex(texts, MAY_ASSIGN), pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, MAY_HEX), pc.match_substring_regex(texts, MAY_SENSE)]
            some = pc.or_(pc.or_(may[0], may[1]), pc.or_(may[2], may[3])).to_pylist()
            may = [x.to_pylist() for x in may]
            spans = []
            for i, any_ in enumerate(some):
                if not any_:
                    spans.append([])
                    continue
                text = texts[i].as_py()
                base = base_spans(text, may[0][i], may[1][i], may[2][i])
                found = [(*x, None) for x in base] + (novel_spans(text, base, how, common) if may[3][i] else [])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "cost": cost} for a, k, b, cost in sorted(found, key=lambda x: x[:3])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return kept.mapInArrow(scan, schema(id=kept.schema["id"].dataType, spans=T.ArrayType(SPAN)))
