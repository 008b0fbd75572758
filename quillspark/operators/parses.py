"""Parser scoring: CoNLL-U projection, alignment of gold and candidate tokens, and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratio import f1, ratio

COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def feats(value: Column) -> Column:
    """"A=1|B=2" as sorted (key, value) pairs; "_" is none."""
    pairs = F.array_sort(F.map_entries(F.str_to_map(value, F.lit(r"\|"), F.lit("="))))
    return F.when((value == "_") | value.isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(pairs)


def conllu_words(blocks: DataFrame) -> DataFrame:
    """A row per syntactic word of CoNLL-U sentences (sent, block): id, form, lemma, upos, feats, head (null for the root),
    deprel, start and end of its surface token in the sentence's text. Ranges ("2-3") are surface tokens of several words.
    Blocks are read where they lie, many at a time by columns, and no word is shuffled. Lines with too few fields and ranges that
    overlap fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                yield placed_words(*big.slice(i, 1000).columns)

    words = blocks.select("sent", "block").mapInArrow(run, WORDS)
    head = F.when(F.col("head") != "0", F.col("head").cast("int"))
    return words.withColumns({"feats": feats(F.col("feats")), "head": head})


WORDS = "sent string, i int, token int, form string, lemma string, upos string, feats string, head string, deprel string, start long, end long"


STRINGS = ("form", "lemma", "upos", "feats", "head", "deprel")


def placed_words(sents: pa.Array, blocks: pa.Array) -> pa.RecordBatch:
    """The words of some blocks, with the places of their surface tokens, heads and features as they are written."""
    at, words = word_columns(blocks)
    columns = [sents.take(pa.array(at)), *(pa.array(x, pa.int32()) if n in ("i", "token") else pa.array(x) if n in ("start", "end") else x for n, x in words.items())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WORDS.split(", ")])


def word_columns(blocks: pa.Array) -> tuple[np.ndarray, dict]:
    """The block of each word, and the words' columns, by block and id."""
    lines = pc.split_pattern(blocks, "\n")
    block, line = pc.list_parent_indices(lines).to_numpy(), lines.flatten()
    told = pc.and_(pc.not_equal(line, ""), pc.invert(pc.starts_with(line, "#")))
    block, fields = block[told.to_numpy(zero_copy_only=False)], pc.split_pattern(line.filter(told), "\t")
    n = pc.list_value_length(fields).to_numpy()
    if (n < len(COLUMNS)).any():
        raise ValueError("a line with too few fields")
    values, begin = fields.flatten(), np.cumsum(n) - n
    of = lambda name, rows: values.take(pa.array(begin[rows] + COLUMNS.index(name)))
    flag = lambda x: x.to_numpy(zero_copy_only=False)
    ids = of("id", np.arange(len(n)))
    empty, wide = flag(pc.match_substring(ids, ".")), flag(pc.match_substring(ids, "-"))
    first = np.zeros(len(n), np.int64)
    last = first.copy()
    plain, ranged = np.flatnonzero(~empty & ~wide), np.flatnonzero(~empty & wide)
    first[plain] = last[plain] = pc.cast(ids.take(pa.array(plain)), pa.int64()).to_numpy()
    ends = pc.split_pattern(ids.take(pa.array(ranged)), "-", max_splits=1)
    first[ranged], last[ranged] = (pc.cast(pc.list_element(ends, k), pa.int64()).to_numpy() for k in (0, 1))
    rows, ranged = (x[np.lexsort((first[x], block[x]))] for x in (plain, ranged))
    wider = (block[ranged][1:] == block[ranged][:-1]) & (first[ranged][1:] <= last[ranged][:-1])
    if wider.any():
        raise ValueError("ranges overlap")

    surface = lambda x: (flag(pc.utf8_length(of("form", x))).astype(np.int64), ~flag(pc.match_substring(of("misc", x), "SpaceAfter=No")))
    at, own, (length, spaced) = block[rows], first[rows], surface(rows)
    opens = np.ones(len(rows), bool)
    if len(ranged):
        place = lambda b, i: (b.astype(np.int64) << 32) + i
        near = np.searchsorted(place(block[ranged], first[ranged]), place(at, own), side="right") - 1
        inside = (near >= 0) & (block[ranged][near] == at) & (own <= last[ranged][near])
        opens = ~inside | (own == first[ranged][near])
        wide_length, wide_spaced = surface(ranged)
        length, spaced = np.where(inside, wide_length[near], length), np.where(inside, wide_spaced[near], spaced)
    width = np.where(opens, length + spaced, 0)
    new = np.append(np.ones(min(len(at), 1), bool), at[1:] != at[:-1])
    held = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))  # where a word's block begins
    before, number = np.cumsum(width) - width, np.cumsum(opens)
    before, token = before - before[held], number - (number - opens)[held]
    # a token begins with its first word
    start = before[np.maximum.accumulate(np.where(new | opens, np.arange(len(at)), 0))]
    named = dict(zip(STRINGS, (of(c, rows) for c in STRINGS)))
    return at, {"i": own, "token": token, **named, "start": start, "end": start + length}


def faults(words: DataFrame) -> DataFrame:
    """Sentences without exactly one root or with a head outside them."""
    n = words.groupBy("sent").agg(F.count_if(F.col("head").isNull()).alias("roots"), F.max("i").alias("last"), F.max("head").alias("far"))
    return n.filter("roots <> 1 or far > last").select("sent")


def aligned(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """Gold and candidate words (sent, i, token span, ...) of equal surface tokens, paired by place in the token; words of
    one side only are kept. g and c are structs, null where a side has none."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("sent", "start", "end").orderBy("i"))
        return df.select("sent", "start", "end", k.alias("k"), F.struct("i", "lemma", "upos", "feats", "head", "deprel").alias(name))

    return placed(gold, "g").join(placed(candidate, "c"), ["sent", "start", "end", "k"], "full_outer")


def scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Word F1, lemma and tag accuracy, FEATS micro F1, UAS and LAS. Heads are compared through the alignment; words that
    one side lacks count as wrong."""
    by = by or []
    heads = pairs.filter("g is not null and c is not null").select(F.col("sent").alias("hs"), F.col("g.i").alias("g_head"), F.col("c.i").alias("c_head"))
    p = pairs.join(heads, (F.col("sent") == F.col("hs")) & (F.col("g.head") == F.col("g_head")), "left")
    both = F.col("g").isNotNull() & F.col("c").isNotNull()
    attached = both & ((F.col("g.head").isNull() & F.col("c.head").isNull()) | F.coalesce(F.col("c.head") == F.col("c_head"), F.lit(False)))
    labelled = attached & F.col("g.deprel").eqNullSafe(F.col("c.deprel"))
    n = lambda cond: F.count_if(cond)
    count = lambda arr: F.sum(F.coalesce(F.size(arr), F.lit(0)))
    none = F.array().cast("array<struct<key:string,value:string>>")
    gf, cf = F.coalesce("g.feats", none), F.coalesce("c.feats", none)
    shared = F.when(both, F.array_intersect(gf, cf)).otherwise(none)
    out = p.groupBy(*by).agg(
        n(both).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("c").isNull()).alias("fn"),
        n(both & F.col("g.lemma").eqNullSafe(F.col("c.lemma"))).alias("lemmas"), n(both & F.col("g.upos").eqNullSafe(F.col("c.upos"))).alias("tags"),
        count(shared).alias("f_tp"), count(F.array_except(cf, shared)).alias("f_fp"), count(F.array_except(gf, shared)).alias("f_fn"),
        n(attached).alias("heads"), n(labelled).alias("labels"),
    )
    return out.select(*by, *rates())


def rates() -> list[Column]:
    """The scores of rows of counts."""
    gold_n = F.col("tp") + F.col("fn")
    return [f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("word_f1"), ratio(F.col("lemmas"), gold_n).alias("lemma_accuracy"), ratio(F.col("tags"), gold_n).alias("upos_accuracy"), f1(F.col("f_tp"), F.col("f_fp"), F.col("f_fn")).alias("feats_f1"), ratio(F.col("heads"), gold_n).alias("uas"), ratio(F.col("labels"), gold_n).alias("las")]


COUNTS = ("tp", "fp", "fn", "lemmas", "tags", "f_tp", "f_fp", "f_fn", "heads", "labels")


def block_scores(blocks: DataFrame) -> DataFrame:
    """What ``scores`` finds of aligned words, where both sides of a sentence lie in one row: gold and candidate, CoNLL-U blocks. A null
    block has no words. Sides are aligned where they lie, many sentences at a time by columns; a row of counts goes on for these, and
    no word is shuffled. A feature twice in a word fails the job, as lines with too few fields and ranges that overlap do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                sides = (word_columns(side) for side in big.slice(i, 1000).columns)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in compared(*sides)], names=list(COUNTS))

    text = (F.coalesce(c, F.lit("")).alias(c) for c in ("gold", "candidate"))
    counts = blocks.select(*text).mapInArrow(run, ", ".join(f"{c} long" for c in COUNTS))
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).select(*rates())


def compared(gold: tuple[np.ndarray, dict], candidate: tuple[np.ndarray, dict]) -> tuple[int, ...]:
    """The counts of two sides of the same blocks. Words are paired by surface token and place in it, heads through the pairs."""
    (g_at, g), (c_at, c) = gold, candidate
    keys = [np.concatenate(x) for x in zip(token_places(g_at, g), token_places(c_at, c))]
    order = np.lexsort((*keys[::-1],))  # stable: of two equal ones, the gold one is first
    twins = np.flatnonzero(np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in keys]))
    mine, theirs = order[twins], order[twins + 1] - len(g_at)
    same = lambda name: pc.equal(g[name].take(pa.array(mine)), c[name].take(pa.array(theirs))).to_numpy(zero_copy_only=False)
    g_head, c_head = (pc.cast(x["head"], pa.int64()).to_numpy()[rows] for x, rows in ((g, mine), (c, theirs)))

    other = np.full(len(g_at) + 1, -1)  # the candidate's id of each gold word; the last is for heads outside the sentence
    other[mine] = c["i"][theirs]
    place = lambda at, i: (at.astype(np.int64) << 32) + i
    own, asked = place(g_at, g["i"]), place(g_at[mine], g_head)
    found = np.searchsorted(own, asked)
    inside = np.append(own, -1)[found] == asked
    attached = np.where(g_head == 0, c_head == 0, (c_head != 0) & (c_head == other[np.where(inside, found, len(g_at))]))

    written = pc.dictionary_encode(pa.concat_arrays([g["feats"], c["feats"]]))
    sets, code = [feature_set(x) for x in written.dictionary.to_pylist()], written.indices.to_numpy()
    both, n = np.unique(code[mine] * np.int64(len(sets)) + code[len(g_at) + theirs], return_counts=True)
    shared = sum(len(sets[p // len(sets)] & sets[p % len(sets)]) * k for p, k in zip(both.tolist(), n.tolist()))
    sizes = np.array([len(x) for x in sets], np.int64)
    g_feats, c_feats = (int(sizes[x].sum()) for x in (code[: len(g_at)], code[len(g_at) :]))
    tp = len(mine)
    return tp, len(c_at) - tp, len(g_at) - tp, int(same("lemma").sum()), int(same("upos").sum()), shared, c_feats - shared, g_feats - shared, int(attached.sum()), int((attached & same("deprel")).sum())


def token_places(at: np.ndarray, words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Block and start, and length and place in the surface token, of words in order."""
    begin, width, row = (at.astype(np.int64) << 40) + words["start"], words["end"] - words["start"], np.arange(len(at))
    new = np.append(np.ones(min(len(at), 1), bool), (begin[1:] != begin[:-1]) | (width[1:] != width[:-1]))
    return begin, (width << 31) + row - np.maximum.accumulate(np.where(new, row, 0))


def feature_set(written: str) -> frozenset[str]:
    """The features ("A=1") of a word."""
    parts = [] if written == "_" else written.split("|")
    if len({p.split("=", 1)[0] for p in parts}) < len(parts):
        raise ValueError("a feature twice in a word")
    return frozenset(parts)
