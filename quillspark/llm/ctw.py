"""Language-model scores by context-tree weighting over bytes.

A text is its words, each followed by one space, and an end symbol; contexts are the last 0 to ``DEPTH`` bytes before a
byte, across word limits (six spaces stand before a text). A byte is eight binary decisions, and each decision has a context
tree of its own: a node's weighted probability is half its Krichevsky-Trofimov estimate and half the product of its
children's, so depths are mixed decision by decision. What is scored does not change the model. A context that training
never saw at a decision ends its path there, and the one above it stands for it.

Training and scoring are tables, not loops over text, and pairs of context and next byte travel in bulk:

* a task cuts its documents into blocks of ``BLOCK_BYTES``. A block gives its distinct pairs and tokens, with their counts in
  its training texts, as one packed list for each bucket, and the compressed documents themselves. This is one written table;
* pairs are dealt to buckets by the two nearest bytes of the context, so that all nodes of two or more bytes lie in one
  bucket; tokens by hash. A bucket adds up its lists and estimates its subtrees, once for all blocks;
* the two levels above need sums for each (byte, decision): at most 65,280 rows whatever the corpus, the one thing that is
  collected and sent to tasks. With them a bucket answers each list in the list's own order, and a block scores its
  documents from its answers. Texts are shuffled once, compressed.

Everything grows with the distinct pairs of a block, not with pairs of documents. The largest bucket is the subtree of the
commonest two bytes.

Defined cases: a null or empty text is its end symbol only; a null id is training text; repeated rows count as often as they
stand; without training text the base score is 0 and every byte has probability 1/256; an empty table gives an empty
result; columns of other names are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, BOOL, DBL, INT, LONG, give_back, quoted, schema, settings, spread, written

DEPTH = 6
END_TOKEN = b"\xff"  # the symbol of a text's end: no byte of a word in UTF-8
TOP = 2  # levels above those that a bucket holds whole
#: Bytes of texts: of a block of documents, of what is cut at once, and for each bucket of their pairs.
BLOCK_BYTES, CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 1 << 20, 4 << 20


def held_out(id_: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def packed(x: np.ndarray) -> bytes:
    """The array's bytes, those of one place value side by side, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shortened(x: np.ndarray) -> np.ndarray:
    """Single floats rounded to 16 bits of fraction, which take a byte less when packed."""
    return ((x.view(np.uint32) + 0x80) & 0xFFFFFF00).view(np.float32)


def rising(data: bytes) -> np.ndarray:
    """A rising list that was packed as its steps."""
    return np.cumsum(unpacked(data, np.int64))


def steps(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=0))


def text_keys(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text index) of each byte of the texts, given as words. A key is the DEPTH bytes before, the nearest first, and the
    byte: contexts with the same nearest bytes are neighbours in order."""
    parts = [b" " * DEPTH + b"".join([w + b" " for w in words]) + END_TOKEN for words in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    length = np.array([len(p) for p in parts], np.int64)
    key = data.copy()
    for k in range(1, DEPTH + 1):
        key[k:] |= data[: len(data) - k] << (8 * (DEPTH + 1 - k))
    own = np.ones(len(data), bool)
    start = np.cumsum(length) - length
    own[(start[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[own], np.repeat(np.arange(len(parts)), length - DEPTH)


def chunks(texts: pa.ChunkedArray) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words in ASCII lower case) of some texts at a time."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES)))
        yield at, [t.lower().split() for t in texts.slice(at, end - at).cast(pa.binary()).to_pylist()]
        at = end


def starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def lengths(start: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.diff(np.append(start, len(whole)))


def added_up(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    order = np.argsort(key)
    key = key[order]
    start = starts(key)
    return key[start], np.add.reduceat(n[order].astype(np.int64), start) if len(start) else n.astype(np.int64)


def contents(texts: pa.ChunkedArray, held: list[bool]) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Distinct keys of the texts in order, how often each stands in those that are not held out, and the same of tokens, the
    end token included."""
    marks, found, tokens = np.array(held, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int32))], Counter()
    for at, some in chunks(texts):
        key, of = text_keys(some)
        key <<= 1
        key |= marks[at + of]
        key.sort()
        start = starts(key)
        runs = key[start]
        found.append((runs >> 1, np.where(runs & 1, 0, lengths(start, key)).astype(np.int32)))
        for words, out in zip(some, held[at:]):
            if out:
                for w in {*words, END_TOKEN}:
                    tokens.setdefault(w, 0)
            else:
                tokens.update(words)
                tokens[END_TOKEN] += 1
    key, n = (np.concatenate(x) for x in zip(*found))
    found.clear()
    return *added_up(key, n), tokens


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): keys by bucket, rising in each; bucket b is order[bounds[b]:bounds[b + 1]]."""
    spread_ = ((key >> (8 * (DEPTH + 1 - TOP))) * 40503 & 0xFFFF) * buckets >> 16
    order = np.argsort(spread_.astype(np.uint16), kind="stable")
    return order, np.searchsorted(spread_[order], np.arange(buckets + 1))


def joined(tokens: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(tokens))


def parted(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def dealt_tokens(tokens: dict[bytes, int], buckets: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for t in sorted(tokens):
        out[zlib.crc32(t) % buckets].append(t)
    return out


#: Buckets 0 to n - 1 hold pairs, n to 2 n - 1 tokens; -1 is a block's documents, with its pairs and its tokens in the
#: order of buckets.
ASKED = schema(block=LONG, bucket=INT, keys=BIN, counts=BIN, docs=BIN, tokens=BIN)
DOCS = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


def asked(rows: DataFrame, buckets: int) -> DataFrame:
    """The blocks of documents (id, held_out, text), and what each asks of every bucket."""

    def finished(block: int, held_rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held_rows, DOCS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own.combine_chunks())
        key, n, tokens = contents(own.column("text"), own.column("held_out").to_pylist())
        lists = dealt_tokens(tokens, buckets)
        made = [(-1, steps(key), None, sink.getvalue().to_pybytes(), joined([t for some in lists for t in some]))]
        order, bounds = dealt(key, buckets)
        for b in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[b] : bounds[b + 1]]
            made.append((int(b), steps(key[at]), packed(n[at]), None, None))
        for b, some in enumerate(lists):
            if some:
                made.append((buckets + b, joined(some), packed(np.array([tokens[t] for t in some], np.int64)), None, None))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        del own, key, n, tokens, lists, order
        give_back()
        return pa.RecordBatch.from_arrays([pa.array([block] * len(made), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*made), kinds))], names=ASKED.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        block, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, DOCS)], schema=DOCS)
            lengths, at = pc.binary_length(batch.column(2)).to_numpy(), 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= BLOCK_BYTES:
                    yield finished(block, [*waiting, batch.slice(at, i + 1 - at)])
                    block, waiting, size, at = block + 1, [], 0, i + 1
            if at < batch.num_rows:
                waiting.append(batch.slice(at))
        if waiting:
            yield finished(block, waiting)

    return rows.select("id", "held_out", "text").mapInArrow(cut, ASKED)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by Stirling's series after eight steps up."""
    y = x + 8
    up = np.zeros_like(x)
    for k in range(8):
        up += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


#: ln of the gamma function at k + 1/2 and at k + 1.
SMALL = 1 << 16
LOG_GAMMA = {x: log_gamma(np.arange(SMALL) + x) for x in (0.5, 1.0)}


def log_gamma_at(k: np.ndarray, more: float) -> np.ndarray:
    out = LOG_GAMMA[more][np.minimum(k, SMALL - 1)]
    big = k >= SMALL
    if big.any():
        out[big] = log_gamma(k[big] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma_at(zeros, 0.5) + log_gamma_at(ones, 0.5) - log_gamma_at(zeros + ones, 1.0) - math.log(math.pi)


class Level:
    """The distinct (context of ``depth`` bytes, next byte) of a bucket in order, their counts, and where each lies above."""

    def __init__(self, depth: int, key: np.ndarray, n: np.ndarray):
        self.depth, self.key, self.n, self.byte, self.up = depth, key, n, key & 255, None

    def above(self) -> Level:
        short = ((self.key >> 16) << 8) | self.byte
        order = np.argsort(short)
        ranked = short[order]
        start = starts(ranked)
        self.up = np.empty(len(short), np.int64)
        self.up[order] = np.repeat(np.arange(len(start)), lengths(start, short))
        return Level(self.depth - 1, ranked[start], np.add.reduceat(self.n[order], start))


def subtrees(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of the pairs of whole subtrees under contexts of TOP bytes: what each subtree gives the pair's eight decisions (not a
    number where training never saw the context), and (context byte and decision, zeros, ones, ln of the children's product)
    of the contexts of one byte, as far as these subtrees go."""
    levels = [Level(DEPTH, key, n)]
    while levels[-1].depth > TOP:
        levels.append(levels[-1].above())
    given, above = np.empty((len(key), 8), np.float32), []
    for level in range(8):
        estimates, log_w, below, child = [], None, None, None
        for x in levels:  # upwards: estimates, weighted probabilities
            start = starts(((x.key >> 8) << 8) | (x.byte >> (8 - level)))
            here = np.repeat(np.arange(len(start)), lengths(start, x.key))
            bit = (x.byte >> (7 - level)) & 1
            both, ones = np.add.reduceat(x.n, start), np.add.reduceat(x.n * bit, start)
            zeros = both - ones
            own = log_kt(zeros, ones)
            if log_w is None:
                share, log_w = None, own
            else:
                below = np.bincount(here[child.up[child_start]], weights=log_w, minlength=len(start))
                either = np.logaddexp(own, below)
                share, log_w = np.exp(own - either)[here], either - math.log(2)
            k = (np.where(bit == 1, ones[here], zeros[here]) + 0.5) / (both[here] + 1)
            estimates.append((k, share, both[here] > 0))
            child, child_start = x, start
        mix, rest, last = np.zeros(len(child.key)), np.ones(len(child.key)), np.full(len(child.key), np.nan)
        for x, (k, share, seen) in zip(reversed(levels), reversed(estimates)):  # downwards: the mixture along each path
            if x is not child:
                mix, rest, last = mix[x.up], rest[x.up], last[x.up]
            if share is not None:
                mix = np.where(seen, mix + rest * share * k, mix)
                rest = np.where(seen, rest * (1 - share), rest)
            last = np.where(seen, k, last)
        given[:, level] = mix + rest * last
        top = child.key[child_start] >> 16  # nearest byte
        at = (top << 8) | (1 << level) | (child.byte[child_start] >> (8 - level))
        kinds, inverse = np.unique(at, return_inverse=True)
        add = lambda v: np.bincount(inverse, weights=v, minlength=len(kinds))
        above.append((kinds, add(zeros).astype(np.int64), add(ones).astype(np.int64), add(log_w)))
    return given, tuple(np.concatenate(x) for x in zip(*above))


class Roots:
    """The contexts of no byte and of one byte: shares and estimates of each decision."""

    def __init__(self, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.k1, self.share1, log_w = self.mixed(at, zeros, ones, below, 1 << 16)
        node = at & 255
        add = lambda x: np.bincount(node, weights=x, minlength=256)
        zeros, ones, below = add(zeros).astype(np.int64), add(ones).astype(np.int64), add(log_w[at])
        self.k0, self.share0, _ = self.mixed(np.arange(256), zeros, ones, below, 256)

    def mixed(self, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        k, share, log_w = np.full((size, 2), np.nan), np.ones(size), np.zeros(size)
        own = log_kt(zeros, ones)
        either = np.logaddexp(own, below)
        seen = zeros + ones > 0
        for bit, count in enumerate((zeros, ones)):
            k[at, bit] = np.where(seen, (count + 0.5) / (zeros + ones + 1), np.nan)
        share[at], log_w[at] = np.exp(own - either), either - math.log(2)
        return k, share, log_w

    def log10_p(self, last: np.ndarray, byte: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Of each pair (byte before, byte), from what the subtrees give."""
        out = np.zeros(len(byte))
        for level in range(8):
            node, bit = (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1
            at = (last << 8) | node
            p = given[:, level].astype(float)
            for k, share in ((self.k1[at, bit], self.share1[at]), (self.k0[node, bit], self.share0[node])):
                p = np.where(np.isnan(p), k, share * k + (1 - share) * p)
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out


#: A row of a bucket with lists has the blocks that asked and, for each, the places of its pairs (or the counts of its
#: tokens), what the subtrees give, and the last two bytes of the pairs; other rows are sums for the levels above (at is the
#: context byte and decision) or, where at is -1, of tokens (zeros: their number in training texts, ones: distinct ones).
GROWN = schema(bucket=INT, given=BIN, ends=BIN, at=LONG, zeros=LONG, ones=LONG, below=DBL).add("blocks", T.ArrayType(LONG)).add("lists", T.ArrayType(BIN))
ANSWER = schema(block=LONG, bucket=INT, answer=BIN)


def grown(asks: DataFrame, buckets: int) -> DataFrame:
    """Every bucket's lists added up, and its subtrees estimated."""

    def result(bucket: int, blocks: list[int], lists: list[bytes], given: bytes | None, ends: bytes | None, sums: tuple) -> pa.Table:
        at, zeros, ones, below = sums
        n = len(at)
        columns = [
            pa.array([bucket] * (n + 1), pa.int32()), pa.array([given] + [None] * n, pa.binary()), pa.array([ends] + [None] * n, pa.binary()),
            *(pa.array([None, *x], k) for x, k in ((at, pa.int64()), (zeros, pa.int64()), (ones, pa.int64()), (below, pa.float64()))),
            pa.array([blocks] + [None] * n, pa.list_(pa.int64())), pa.array([lists] + [None] * n, pa.list_(pa.binary())),
        ]
        return pa.table(columns, names=GROWN.names)

    def grow(group: pa.Table) -> pa.Table:
        give_back()
        bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        keys, counts = group.column("keys").to_pylist(), [unpacked(c, np.int64) for c in group.column("counts").to_pylist()]
        if bucket >= buckets:
            tokens = [parted(k) for k in keys]
            total: Counter[bytes] = Counter()
            for some, n in zip(tokens, counts):
                for t, k in zip(some, n.tolist()):
                    total[t] += k
            lists = [packed(np.array([total[t] for t in some], np.int64)) for some in tokens]
            return result(bucket, blocks, lists, None, None, ([-1], [sum(total.values())], [sum(k > 0 for k in total.values())], [0.0]))
        keys = [rising(k) for k in keys]
        key, n = added_up(np.concatenate(keys), np.concatenate(counts))
        given, sums = subtrees(key, n)
        lists = [steps(np.searchsorted(key, k)) for k in keys]
        return result(bucket, blocks, lists, packed(given.ravel()), packed((((key >> (8 * DEPTH)) << 8) | (key & 255)).astype(np.uint16)), tuple(x.tolist() for x in sums))

    return asks.filter("bucket >= 0").select("block", "bucket", "keys", "counts").groupBy("bucket").applyInArrow(grow, GROWN)


def answered(table: DataFrame, roots: Roots) -> DataFrame:
    """block, bucket, answer: log10 probabilities of a list's pairs (single floats), or training counts of its tokens."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, given, ends, blocks, lists in zip(*(batch.column(i) for i in range(5))):
                lists, p = lists.as_py(), None
                if given.is_valid:
                    end = unpacked(ends.as_py(), np.uint16).astype(np.int64)
                    p = roots.log10_p(end >> 8, end & 255, unpacked(given.as_py(), np.float32).reshape(-1, 8)).astype(np.float32)
                    lists = [packed(shortened(p[rising(x)])) for x in lists]
                yield pa.RecordBatch.from_arrays([blocks.values, pa.array([bucket.as_py()] * len(lists), pa.int32()), pa.array(lists, pa.binary())], names=ANSWER.names)

    return table.filter("blocks is not null").select("bucket", "given", "ends", "blocks", "lists").mapInArrow(answer, ANSWER)


SCORE = schema(id=LONG, held_out=BOOL, n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=DBL, score=DBL, bits_per_byte=DBL)
SCORE_ARROW = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in SCORE.names[2:5]), *((c, pa.float64()) for c in SCORE.names[5:])])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts, base score by token frequencies, and the model's score, both log10 probabilities."""
    id_, text = quoted(id_col).cast("long"), F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = spread(docs.select(id_.alias("id"), held_out(id_).alias("held_out"), text.alias("text")))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES + 1), 1 << 8 * TOP)
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        asks = written(asked(rows, buckets), "asked")
    table = written(grown(asks, buckets), "grown")
    sums = table.filter("at is not null").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).collect()  # at most 256 x 255 + 1
    n, v = next(((r["zeros"], r["ones"]) for r in sums if r["at"] < 0), (0, 0))
    roots = Roots(*(np.array([r[c] for r in sums if r["at"] >= 0], t) for c, t in (("at", np.int64), ("zeros", np.int64), ("ones", np.int64), ("below", float))))
    floor = math.log10(n + 0.5 * (v + 1))

    def score(group: pa.Table) -> pa.Table:
        give_back()
        at = {b: k for k, b in enumerate(group.column("bucket").to_pylist())}
        read = lambda name, b: group.column(name)[at[b]].as_py()
        own = pa.ipc.open_stream(read("docs", -1)).read_all()
        texts, key = own.column("text"), rising(read("keys", -1))
        order, bounds = dealt(key, buckets)
        p = np.empty(len(key), np.float32)
        for b in np.flatnonzero(np.diff(bounds)):
            p[order[bounds[b] : bounds[b + 1]]] = unpacked(read("answer", int(b)), np.float32)
        counts = np.concatenate([unpacked(read("answer", b), np.int64) for b in sorted(at) if b >= buckets])
        count = dict(zip(parted(read("tokens", -1)), counts.tolist()))
        out: list[tuple[np.ndarray, ...]] = []
        for _, some in chunks(texts):
            pair, of = text_keys(some)
            order = np.argsort(pair)
            pair = pair[order]
            start = starts(pair)
            logs = np.repeat(p[np.searchsorted(key, pair[start])], lengths(start, pair))
            for words in some:
                words.append(END_TOKEN)
            size = np.array([len(words) for words in some])
            first = np.cumsum(size) - size
            c = np.fromiter(map(count.__getitem__, chain.from_iterable(some)), np.int64, size.sum())
            base = np.add.reduceat(np.log10(c + 0.5), first) - floor * size
            out.append((size, np.add.reduceat((c > 0).astype(np.int64), first), base, np.bincount(of[order], weights=logs, minlength=len(some))))
        size, known, base, total = (np.concatenate(x) for x in zip(*out))
        bits = -total / math.log10(2) / (pc.binary_length(texts).to_numpy() + 1)
        return pa.table([own.column("id"), own.column("held_out"), size, known, np.full(len(size), n), base, total, bits], schema=SCORE_ARROW)

    blocks = asks.filter("bucket = -1").select("block", "bucket", "keys", "docs", "tokens")
    return blocks.unionByName(answered(table, roots), allowMissingColumns=True).groupBy("block").applyInArrow(score, SCORE)
