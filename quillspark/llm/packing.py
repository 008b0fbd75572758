"""Mixture-controlled packing of tokens into windows.

Every source is a queue of its documents' tokens. Windows are filled by deficit round-robin: after each window, every
queue has sent its share of all tokens sent so far to within half a token plus what evens out the sum, and what it is
short of is carried into the next window. Since queues send in fixed proportions, the tokens a queue has sent by the end
of window w have a closed form, so a task needs no other task's deficits: it computes those of its own windows, and they
agree across partitions. Where target weights are given, the proportions hold until a queue runs dry; what is left then
goes on in the remaining queues' proportions (a phase), and no token is dropped.

A document is cut where its queue's turn in a window ends. The rest that fills no window becomes sequences whose lengths
are the powers of two that add up to it, so nothing is padded.

Steps: tokenise once into a written table with each document's offset among its partition's tokens of its queue; add up a
row per partition and queue; prefix sums of those give offsets in the queue; cut. Every source is a queue of its own, and
only queue totals reach the driver: a number a source. Beyond ``most_queues`` sources, which is an error, proportions of
windows would say nothing.

Defined cases: a null or empty text is its end token only; a null source is a queue of its own; null ids and repeated rows
are packed like others; an empty table gives no pieces; columns of other names are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BIN, INT, LONG, STR, quoted, schema, spread, written

PIECE = schema(id=LONG, start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG, sequence_id=LONG, offset=LONG, queue=STR, queue_offset=LONG)
TOKENS = schema(id=LONG, queue=STR, file=STR, block=LONG, part=INT, place=LONG, n=LONG, ids=BIN)
#: Runs that a worker remembers (some 200 bytes each), and the longest of them in bytes.
MOST_CACHED, LONGEST_CACHED = 800_000, 64
STOPS = b".,;:!?"
LAST = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz0123456789")


class Encoder:
    """Ids of whole texts as unsigned 16-bit bytes.

    The tokenizer drops white space, lower-cases, and parts letters from punctuation; so ids of a text are those of its
    runs between ASCII white space, ids of a run those of its ASCII lower-case form (unless a special token may be spelt in
    it), and ids of letters with stops behind them those of both parts. Runs come from a cache of two generations: when the
    younger is full it becomes the older one, from which runs that are met again come back, and the older one goes.
    """

    def __init__(self, path: str, most: int = MOST_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids that end a word. Letters only are one word, so ids of many such runs at once fall apart at these.
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and i < 1 << 16]] = True
        self.most = most
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded as one text; none if they do not fall apart into as many words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words) or cut[-1] != len(ids):
            return []
        data, cut = ids.tobytes(), (2 * cut).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def fresh(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs that are not in the cache."""
        ids: dict[bytes, bytes] = {}
        known = self.cache
        stopped = [w for w in runs if w[-1] in STOPS and w.rstrip(STOPS)[-1:] in LAST and b"<|" not in w]
        need = dict.fromkeys(runs)
        for w in stopped:
            del need[w]
        for w in stopped:
            core = w.rstrip(STOPS)
            for part in (core, w[len(core) :]):
                if part not in known:
                    need[part] = None
        letters = [(w, t) for w, t in zip(need, b"\n".join(need).decode().split("\n")) if t.isalpha()]
        for i in range(0, len(letters), 1024):
            part = letters[i : i + 1024]
            ids |= zip([w for w, _ in part], self.together([t for _, t in part]))
        rest = [w for w in need if w not in ids]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                ids[w] = np.array(e.ids, "<u2").tobytes()
        for w in stopped:
            core = w.rstrip(STOPS)
            tail = w[len(core) :]
            ids[w] = (ids[core] if core in ids else known[core]) + (ids[tail] if tail in ids else known[tail])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = []
        for t in texts:
            data = t.encode()
            runs.append((data if b"<|" in data else data.lower()).split())
        met = [list(map(self.cache.get, r)) for r in runs]
        holes = [[k for k, x in enumerate(ids) if x is None] for ids in met]
        new = {r[k] for r, own in zip(runs, holes) for k in own}
        again = {w: self.older[w] for w in new if w in self.older}
        self.cache |= again
        found = self.fresh(list(new - again.keys()))
        self.cache |= found
        for r, ids, own in zip(runs, met, holes):
            for k in own:
                ids[k] = self.cache[r[k]]
        out = list(map(b"".join, met))
        for w in found:
            if len(w) > LONGEST_CACHED:
                del self.cache[w]
        if len(self.cache) > self.most // 2:
            self.older, self.cache = self.cache, {}
        return out


@lru_cache(maxsize=1)
def encoder(path: str, most: int) -> Encoder:
    """One of a worker process, which lives longer than a task."""
    return Encoder(path, most)


def queue_name(source: F.Column) -> F.Column:
    """A source's own queue."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str, file_order: bool, most_cached: int) -> DataFrame:
    """id, queue, where it was read (file, block, partition), place (tokens of the queue before it there), n, ids."""
    source = quoted(source_col).cast("string")
    read = (F.input_file_name(), F.input_file_block_start()) if file_order else (F.lit(""), F.lit(0).cast("long"))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), queue_name(source).alias("queue"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), read[0].alias("file"), read[1].alias("block"))
    rows = rows if file_order else spread(rows)
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sent, part = encoder(tokenizer, most_cached), {}, TaskContext.get().partitionId()
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                ids = [x + end for x in codes.encode(batch.column(2).to_pylist())]
                places = []
                for *q, x in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4)), ids):
                    places.append(sent.get(tuple(q), 0))
                    sent[tuple(q)] = places[-1] + len(x) // 2
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), n, pa.array(ids, pa.binary())], names=TOKENS.names)

    return rows.mapInArrow(encode, TOKENS)


def phases(totals: list[int], weights: list[float] | None, window: int) -> list[list[int]]:
    """Tokens that each queue sends in each phase. Without weights there is one phase with everything; else a phase lasts
    until a queue runs dry, and all but the last are whole windows."""
    left, out = list(totals), []
    while weights and sum(left):
        open_ = [k for k, n in enumerate(left) if n and weights[k] > 0]
        if len(open_) < 2:
            break
        turns = min(left[k] / weights[k] for k in open_)
        sent = [min(left[k], int(turns * weights[k])) if k in open_ else 0 for k in range(len(left))]
        over = sum(sent) % window
        while over:
            k = max(range(len(sent)), key=sent.__getitem__)
            cut = min(over, sent[k])
            sent[k] -= cut
            over -= cut
        if not sum(sent):
            dry = min(open_, key=lambda k: left[k] / weights[k])  # under a window is left at these proportions
            weights = [0 if k == dry else w for k, w in enumerate(weights)]
            continue
        out.append(sent)
        left = [a - b for a, b in zip(left, sent)]
    return [*out, left] if sum(left) or not out else out


class Rounds:
    """How many tokens each queue has sent by the end of each window of a phase."""

    def __init__(self, sent: list[int], window: int):
        self.window, self.total = window, sum(sent)
        wide = 2 * self.total * (max(sent, default=0) + 1) >= 1 << 62
        self.sent = np.array(sent, object if wide else np.int64)
        self.float = np.maximum(np.array(sent, float), 1e-9)
        self.blocks: dict[int, np.ndarray] = {}

    def ends(self, w: np.ndarray) -> np.ndarray:
        """A row for each w: tokens of every queue in the first w windows. Rows add up to w windows, or to all tokens.

        Token j of a queue stands at (j + 1/2) / its tokens, ties by the queue's number; a row holds the first tokens in this
        order, so that no queue ever takes one back, however many queues there are.
        """
        x = np.minimum(w.astype(self.sent.dtype) * self.window, self.total)[:, None]
        out = ((2 * self.sent * x + self.total) // max(2 * self.total, 1)).astype(np.int64)
        for k, short in enumerate((x[:, 0].astype(np.int64) - out.sum(axis=1)).tolist()):
            while short:
                short -= self.settled(out[k], short)
        return out

    def settled(self, row: np.ndarray, short: int) -> int:
        """Adds the next tokens to a row, or takes the last ones off, up to ``short``; how many it added. Only queues whose turn
        comes before any queue's second one move at once."""
        sign = 1 if short > 0 else -1
        may = row < self.sent.astype(np.int64) if sign > 0 else row > 0
        turn = np.where(may, sign * (2 * row + sign) / (2 * self.float), np.inf)
        second = sign * (2 * row + 3 * sign) / (2 * self.float)
        last = turn.size - 1
        order = np.argsort(turn, kind="stable") if sign > 0 else last - np.argsort(turn[::-1], kind="stable")
        sure = int(np.searchsorted(turn[order], second[may].min(), side="left"))
        moved = order[: min(abs(short), max(sure, 1))]
        row[moved] += sign
        return sign * len(moved)

    def upto(self, lo: int, hi: int) -> np.ndarray:
        """ends() of lo to hi, from blocks of up to 256 windows that are kept while they are near; the more queues, the smaller."""
        size = max(1, min(256, (1 << 18) // max(len(self.sent), 1)))
        need = range(lo // size, hi // size + 1)
        for b in need:
            if b not in self.blocks:
                self.blocks[b] = self.ends(np.arange(b * size, b * size + size + 1))
        rows = np.concatenate([self.blocks[b][:size] for b in need] + [self.blocks[need[-1]][size:]])
        while len(self.blocks) > 64:
            self.blocks.pop(next(iter(self.blocks)))
        return rows[lo - need[0] * size : hi - need[0] * size + 1]


def cut_pieces(rounds: Rounds, q: int, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, window, offset) of the pieces of queue tokens [a, b): the last window may be a part.

    Done in stretches of some 256 windows; where a queue sends less than a token in so many, token by token, at the windows
    around its place only.
    """
    scale = rounds.total / float(rounds.sent[q]) / rounds.window
    margin, step = 3 + len(rounds.sent) // rounds.window, max(1, int(256 / scale))
    held: tuple[int, int, int, int] | None = None
    while a < b:
        stop = min(b, a + step)
        lo, hi = max(0, int((a + 0.5) * scale) - margin), int((stop - 0.5) * scale) + margin
        ends = rounds.upto(lo, hi) if step > 1 else rounds.ends(np.arange(lo, hi + 1))
        column = ends[:, q]
        k = int(np.searchsorted(column, a, side="right")) - 1
        last = int(np.searchsorted(column, stop, side="left"))
        before = np.diff(ends[k : last + 1, :q].sum(axis=1)).tolist()  # tokens of the queues before it in each window
        column, lo, k = column[k : last + 1].tolist(), lo + k, 0
        while a < stop:
            to = min(stop, column[k + 1])
            if to > a:
                if held and held[2] == lo + k:  # a window that the last stretch ended in
                    held = (held[0], to, *held[2:])
                else:
                    if held:
                        yield held
                    held = (a, to, lo + k, before[k] + a - column[k])
                a = to
            k += 1
    if held:
        yield held


def tail_parts(rest: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences of the rest: its powers of two, the largest first."""
    out, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_queues: int = 20_000, file_order: bool = False, most_cached: int = MOST_CACHED) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, queue_offset (of its document's first
    token among the tokens of the queue, which tells repeated rows apart).

    weights: target token proportions by source; by default those of the table, so that every window mixes alike. file_order: queues
    follow the names of the table's files and the order in them; else tasks. most_cached: runs whose ids a worker remembers; it
    bounds memory and does not change results.
    """
    table = written(tokenised(docs, tokenizer, end_id, id_col, text_col, source_col, file_order, most_cached), "tokens")
    where = ["queue", "file", "block", "part"]
    sums = table.groupBy(*where).agg(F.sum("n").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("queue").orderBy(*where[1:]).rowsBetween(Window.unboundedPreceding, -1))
    bases = written(sums.select(*where, "tokens", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    totals = {r["queue"]: r["t"] for r in bases.groupBy("queue").agg(F.sum("tokens").alias("t")).limit(most_queues + 1).collect()}
    if len(totals) > most_queues:
        raise ValueError(f"over {most_queues} sources")
    names = sorted(totals)
    by_queue = None
    if weights:
        told = {"null" if k is None else f"={k}": float(v) for k, v in weights.items()}
        by_queue = [told.get(x, 0.0) for x in names]
    sent = phases([totals[x] for x in names], by_queue, window)
    starts = np.cumsum([[0] * len(names), *sent], axis=0).tolist()
    first = np.cumsum([0, *(-(-sum(s) // window) for s in sent)]).tolist()
    index = {x: k for k, x in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = [Rounds(s, window) for s in sent]
        whole = [r.total // window for r in rounds]
        tail = tail_parts(rounds[-1].total % window) if rounds else []
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                rows: tuple[list, ...] = tuple([] for _ in range(9))
                for id_, queue, at, n, ids in zip(*(c.to_pylist() for c in big.slice(i, 2000).columns)):
                    q, wide = index[queue], np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for p, r in enumerate(rounds):
                        a, b = max(at, starts[p][q]), min(at + n, starts[p + 1][q])
                        if a >= b:
                            continue
                        for x, y, w, offset in cut_pieces(r, q, a - starts[p][q], b - starts[p][q]):
                            x, y = x + starts[p][q] - at, y + starts[p][q] - at
                            if w < whole[p]:
                                placed = [(x, y, first[p] + w, offset)]
                            else:  # the rest of the last phase
                                placed = [(max(x, x + s - offset), min(y, x + s + size - offset), first[p] + w + t, max(0, offset - s)) for t, (s, size) in enumerate(tail) if s < offset + y - x and offset < s + size]
                            for u, v, sequence, o in placed:
                                for to, value in zip(rows, (id_, u, v - u, zlib.crc32(wide[4 * u : 4 * v]), n, sequence, o, queue, at)):
                                    to.append(value)
                kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=PIECE.names)

    placed = table.join(bases.select(*where, "base"), where).select("id", "queue", (F.col("base") + F.col("place")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, PIECE)
