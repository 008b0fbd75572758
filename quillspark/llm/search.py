"""Ranked lexical search by sort-based accumulation.

Terms are the runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A first pass over the
documents keeps, by blocks of documents, the postings of those terms that some item asks for (term, frequency), and counts
documents, terms and document frequencies. A second pass goes over these postings only: for every posting its impact goes to
each item that holds the term; the matched (item, document, impact) arrays of a slice are concatenated, their packed keys
radix-sorted, impacts of equal keys added with ``reduceat``. Documents are dealt to tasks by ranges of the table, so all
impacts of a key lie in one slice of one task, whatever the size of the corpus; a heap an item keeps the best of a task, and
the heaps of all tasks (``top`` rows an item each) are merged by a window with a partial top first.

The items are a stated query set: they are worked off in blocks of about ``block_terms`` item terms, each a pass over the
documents, so what a task holds of them (two arrays and a dictionary) is bounded whatever their number. The driver sees a
block's terms with their document frequencies, and no documents.

Defined cases: a null or empty text has no terms, neither found nor counted; items without terms have no rows; rows of one
item id (null too) are one item with the terms of all; repeated documents are documents of their own, each with a rank; null
document ids come last among equal scores; empty tables give no rows; columns of other names are ignored. Long texts are
split in slices of a megabyte, cut between terms. Ids must be integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, quoted, schema, spread, text_or_empty, written

#: Bytes outside terms become spaces, A-Z lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SLICE = 1 << 20
MOST_TRIPLES = 1 << 21
BLOCK = schema(ids=T.ArrayType(LONG), n=BIN, posts=BIN, term=BIN, tf=BIN, docs=LONG, words=LONG, df_term=T.ArrayType(INT), df=T.ArrayType(LONG))
BEST = schema(item_id=LONG, doc_id=LONG, score=LONG)


def term_slices(text: str) -> Iterator[list[bytes]]:
    """All terms of a text, in lists of bounded size."""
    data = text.encode().translate(FOLD)
    at = 0
    while len(data) - at > SLICE:
        cut = data.rfind(b" ", at + 1, at + SLICE)
        if cut < 0:  # one term goes on
            cut = data.find(b" ", at + SLICE)
            if cut < 0:
                break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, terms (distinct, of all rows of the item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list({w for s in term_slices(t) for w in s}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = items.select(quoted(item_col).cast("long").alias("item"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, schema(item=LONG, terms=T.ArrayType(BIN))).select("item", F.explode("terms").alias("term"))
    return found.groupBy("item").agg(F.collect_set("term").alias("terms"))


def postings(rows: DataFrame, vocabulary, block_docs: int) -> DataFrame:
    """Blocks of documents with the postings of known terms, and a row a task with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        docs = words = 0
        for whole in batches:
            for at in range(0, whole.num_rows, block_docs):
                batch = whole.slice(at, block_docs)
                n, term, tf, posts = [], [], [], []
                for text in batch.column("text").to_pylist():
                    length, parts = 0, []
                    for found in term_slices(text):
                        length += len(found)
                        parts.append(np.array([k for k in map(known.get, found) if k is not None], np.int32))
                    ids, counts = np.unique(np.concatenate(parts), return_counts=True)
                    n.append(length)
                    term.append(ids)
                    tf.append(counts)
                    posts.append(len(ids))
                    df[ids] += 1
                docs += np.count_nonzero(n)
                words += sum(n)
                packed = [np.array(n, "<i8"), np.array(posts, "<i8"), np.concatenate(term).astype("<i4"), np.concatenate(tf).astype("<i8")]
                yield pa.RecordBatch.from_pydict({"ids": [batch.column("id").to_pylist()], **{k: [v.tobytes()] for k, v in zip(("n", "posts", "term", "tf"), packed)}, "docs": [None], "words": [None], "df_term": [None], "df": [None]}, schema=BLOCK_ARROW)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"ids": [None], "n": [None], "posts": [None], "term": [None], "tf": [None], "docs": [int(docs)], "words": [int(words)], "df_term": [held.tolist()], "df": [df[held].tolist()]}, schema=BLOCK_ARROW)

    return rows.mapInArrow(run, BLOCK)


BLOCK_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("n", "posts", "term", "tf")), ("docs", pa.int64()), ("words", pa.int64()), ("df_term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))]
)


def radix_order(keys: np.ndarray, low: int, high: int) -> np.ndarray:
    """A stable order of unsigned keys by their bits from ``low`` to ``high``, 16 at a time (numpy sorts these by radix)."""
    order = None
    for at in range(low, high, 16):
        digit = ((keys if order is None else keys[order]) >> np.uint64(at)).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def accumulate(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, start: np.ndarray, items: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of impacts by item and document, in slices of whole documents. Postings come in the order of documents; the
    items of term t are ``items[start[t]:start[t + 1]]``."""
    many = start[term + 1] - start[term]
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))  # where a document's postings end
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(doc):
        k = np.searchsorted(total[ends], total[at] + MOST_TRIPLES, "right")
        end = ends[k - 1] if k and ends[k - 1] > at else ends[np.searchsorted(ends, at, "right")]
        some = many[at:end]
        place = np.arange(total[end] - total[at]) + np.repeat(start[term[at:end]] - (total[at:end] - total[at]), some)
        first = doc[at]
        local = np.repeat((doc[at:end] - first).astype(np.uint64), some)
        keys = (items[place].astype(np.uint64) << np.uint64(32)) | local
        order = radix_order(keys, 32, 32 + max(1, int(n_items - 1).bit_length()))  # documents are in order already
        keys = keys[order]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if len(cuts):
            sums = np.add.reduceat(np.repeat(impact[at:end], some)[order], cuts)
            keys = keys[cuts]
            yield (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) + first, sums
        at = end


class Heaps:
    """The best of each item so far: higher scores first, then smaller ids."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.score = np.zeros(n_items, np.int64)  # of the last that stays; what scores no more goes
        self.id = np.full(n_items, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, ids: np.ndarray, none: np.ndarray, score: np.ndarray) -> None:
        """Ids where ``none`` is set are null, which is after all others."""
        worst = self.score[item]
        with_id = np.where(none, np.iinfo(np.int64).max, ids)
        keep = np.flatnonzero((score > worst) | ((score == worst) & (with_id < self.id[item])))
        # best first, so that all but a few are held against a full heap
        for k in keep[np.argsort(-score[keep], kind="stable")].tolist():
            i = int(item[k])
            heap, row = self.heaps[i], (int(score[k]), -(1 << 63) if none[k] else -int(ids[k]))
            if len(heap) < self.top:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.top:
                self.score[i], self.id[i] = heap[0][0], min(-heap[0][1], np.iinfo(np.int64).max)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, heap in enumerate(self.heaps):
            for score, key in heap:
                yield i, None if key == -(1 << 63) else -key, score


def best_of_tasks(blocks: DataFrame, query, top: int, n_docs: int, n_words: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, items, weight = query.value
        heaps = Heaps(len(names), top)
        for batch in batches:
            for row in batch.to_pylist():
                n, posts, term, tf = (np.frombuffer(row[c], t) for c, t in (("n", "<i8"), ("posts", "<i8"), ("term", "<i4"), ("tf", "<i8")))
                none = np.array([x is None for x in row["ids"]], bool)
                ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
                doc = np.repeat(np.arange(len(n)), posts)
                m = 10 + (90 * n * n_docs) // n_words
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for item, d, score in accumulate(term, doc, impact, start, items, len(names)):
                    heaps.add(item, ids[d], none[d], score)
        rows = list(heaps.rows())
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _, _ in rows], pa.int64()), pa.array([d for _, d, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64())], names=BEST.names)

    return blocks.filter(F.col("ids").isNotNull()).select("ids", "n", "posts", "term", "tf").mapInArrow(run, BEST)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 200_000, block_docs: int = 2048) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0.

    block_terms: item terms (some 100 bytes each) that tasks hold at a time; more items make more passes over the documents.
    block_docs: documents whose postings are one row.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    asked = written(item_terms(items, item_col, item_text_col), "items")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_terms))
    rows = spread(docs.select(quoted(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))
    best = None
    for k in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit("null"))), F.lit(blocks)) == k).toArrow()
        names = own.column("item").to_pylist()
        terms = own.column("terms").to_pylist()
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in terms for w in ws))}
        pairs = np.array([(known[w], i) for i, ws in enumerate(terms) for w in ws], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        start = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(known)))])
        found = written(postings(rows, context.broadcast(known), block_docs), "postings")
        counts = found.filter(F.col("docs").isNotNull())
        sums = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        df = counts.select(F.explode(F.arrays_zip("df_term", "df")).alias("x")).groupBy("x.df_term").agg(F.sum("x.df").alias("df")).toArrow()
        held = dict(zip(df.column(0).to_pylist(), df.column(1).to_pylist()))
        weight = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * held[i] + 1))) if i in held else 0 for i in range(len(known))], np.int64)
        part = best_of_tasks(found, context.broadcast((names, start, pairs[:, 1].astype(np.uint32), weight)), top, sums["docs"], max(1, sums["words"]))
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
