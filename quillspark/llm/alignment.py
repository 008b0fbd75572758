"""Alignment of two tokenizers' tokens by byte offsets, with counts in id-striped dense matrices.

Side A is a byte-level tokenizer over space and text, side B a piece tokenizer over the text, which adds the space itself.
Where tokens of both sides end at one byte, these two are linked, and such ends cut both into groups. The corpus-wide count of
an id pair is the number of links that hold it; a pair is best if no other pair of its B id has a higher count.

Neither tokenizer joins bytes across a space that follows a character that is no white space (no piece holds such a space
inside; ``Pair.cuts`` looks, and texts stay whole otherwise). So ids, links and groups of a text are those of its units,
which run from such a space to the next, and a worker remembers units; every text is still encoded whole.

Steps. (1) Blocks of documents are encoded once into a written table: a row a block with the digests of its documents, and for
each stripe of B ids a row with the distinct pairs of the block in that stripe, how often each is linked, and in which
documents. (2) Rows of a stripe go to ``slots`` of it, so many that one slot holds about ``slot_links`` links however hot an
id is; each adds its pairs into a dense block (rows are B ids, columns A ids) with ``np.add.at`` and hands on the cells that
are not 0, which are added up a stripe; row maxima of the dense block tell the best pairs. (3) The counts of a stripe go to
its slots, beside the links, which are scored where they lie. (4) Sums of a block's documents from all stripes meet in one
group of bounded size, a row a stripe at most. Only the link totals of the stripes reach the driver. No text is shuffled but
where the table has fewer parts than the cluster cores.

Defined cases: a null or empty text, and one whose tokens do not spell space and text on either side, has zeros and an empty
digest; null ids and repeated rows are documents like others; an empty table gives no rows; columns of other names are
ignored; special tokens' names inside texts are plain text. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, INT, LONG, STR, give_back, quoted, schema, spread, text_or_empty, written

#: White space before a space: no cut there.
GLUED = re.compile(r"[\s▁]\x20")
#: Units that a worker remembers, and the longest of them in characters.
MOST_UNITS, LONGEST_UNIT = 400_000, 48
#: Rows of the first table. ``stripe`` is -1 in rows of documents.
BLOCK = schema(block=LONG, stripe=INT, links=LONG, pairs=BIN, docs=BIN, table=BIN)
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("links", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary()), ("table", pa.binary())])
ALIGNED = schema(id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, n_best=LONG, count_sum=LONG, groups_sha256=STR)
COUNTS = schema(stripe=INT, counts=BIN)
PAIRS, CELLS = np.dtype([("b", "<u4"), ("a", "<u4"), ("n", "<u4")]), np.dtype([("b", "<u4"), ("a", "<u4"), ("n", "<i8"), ("best", "u1")])
SUMS = np.dtype([("doc", "<u4"), ("best", "<u4"), ("sum", "<i8")])
DOCS = schema(block=LONG, docs=BIN)
MOST_CELLS = 1 << 20


def packed(x: np.ndarray) -> bytes:
    """Compressed, field by field."""
    fields = [x[c] for c in x.dtype.names] if x.dtype.names else [x]
    return zstandard.compress(b"".join(f.tobytes() for f in fields), 1)


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(data)
    if not kind.names:
        return np.frombuffer(raw, kind)
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for c in kind.names:
        size = kind[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], kind[c])
        at += size
    return out


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level entries: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Pieces that side A's pattern parts a text into before it merges bytes. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JOINED = 100_000  # characters of units that are encoded as one text


def ranks_of(tokenizer, of: dict[str, int]) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level tokenizer whose ids rank its merges, so that another encoder gives the same ids; None of
    any other."""
    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    entries = {t: i for t, i in model["vocab"].items() if t not in special}
    if made != sorted(set(made)) or len(entries) != 256 + len(made) or not all(c in of for t in entries for c in t):
        return None
    return {bytes(of[c] for c in t): i for t, i in entries.items()}


class Pair:
    """Both tokenizers, and the units met so far as rows of flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of()
        ranks = ranks_of(self.a, of)
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        entries = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = max(entries) + 1, len(pieces)
        self.bytes_a = [entries.get(i, b"") for i in range(self.n_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        number = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.shown_a, self.shown_b = ((number(self.n_a, ","), number(self.n_a, "|")), (number(self.n_b, ","), number(self.n_b, ";")))
        self.digits = np.array([len(str(i)) + 1 for i in range(max(self.n_a, self.n_b))])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # of each unit
        self.sizes = array("q")  # tokens of A, of B, groups, whether it spells the text: four a unit
        self.starts = array("q", [0])
        self.links = array("Q")  # b and a of each link

    def units(self, text: str) -> list[str]:
        """What lies between the spaces at which the text is cut; a unit stands for a space and itself."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if parts[0] and parts[-1] and not GLUED.search(text):
            return parts
        out: list[str] = []
        for p in parts:
            if out and (not out[-1] or ends_open(out[-1])):
                out[-1] += " " + p
            else:
                out.append(p)
        if len(out) > 1 and not out[-1]:
            out[-2:] = [out[-2] + " "]
        return out

    def learn(self, units: list[str]) -> None:
        """Encodes units and notes their links and groups. Many units are encoded as one text, since neither side joins bytes
        across the cuts; those that end in white space are encoded alone."""
        some, chars = [], 0
        for u in units:
            if not self.cuts or not u or ends_open(u):
                self.note([u])
                continue
            some.append(u)
            chars += len(u) + 1
            if chars > JOINED:
                self.note(some)
                some, chars = [], 0
        if some:
            self.note(some)

    def note(self, units: list[str]) -> None:
        """Rows of the units, from one text of them all. If that is not spelt by both sides, unit by unit."""
        text = " ".join(units)
        data = f" {text}".encode()
        ids_a = self.quick.encode_to_numpy(f" {text}") if self.quick else np.array(self.a.encode(f" {text}", add_special_tokens=False).ids, np.int64)
        ids_a, ids_b = ids_a.astype(np.int64), np.array(self.b.encode(text), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        right = b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == data
        edges = np.cumsum([len(u.encode()) + 1 for u in units])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if right and len(units) > 1:
            right = bool(np.isin(edges, both, assume_unique=True).all())
        if not right and len(units) > 1:
            for u in units:
                self.note([u])
            return
        for u in units:
            self.known[u] = len(self.groups)
            self.groups.append("")
        if not right:
            self.sizes.extend((len(ids_a), len(ids_b), 0, 0))
            self.starts.append(len(self.links))
            return
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        self.links.frombytes(((ids_b[last_b].astype(np.uint64) << np.uint64(32)) | ids_a[last_a].astype(np.uint64)).tobytes())
        # tokens in the order in which groups show them: those of A, then those of B
        own_a, own_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[own_a]
        place_b = np.arange(len(ids_b)) + last_a[own_b] + 1
        parts = np.empty(len(ids_a) + len(ids_b), object)
        width = np.empty(len(parts), np.int64)
        for ids, place, last, own, shown in ((ids_a, place_a, last_a, own_a, self.shown_a), (ids_b, place_b, last_b, own_b, self.shown_b)):
            parts[place] = np.where(last[own] == np.arange(len(ids)), shown[1][ids], shown[0][ids])
            width[place] = self.digits[ids]
        whole = "".join(parts.tolist())
        upto_a, upto_b, upto = (np.searchsorted(x, edges, "right") for x in (ends_a, ends_b, both))
        at = np.concatenate([[0], np.cumsum(width)])[upto_a + upto_b].tolist()
        first = len(self.groups) - len(units)
        self.groups[first:] = [whole[i : j - 1] for i, j in zip([0, *at], at)]
        counts = np.column_stack([*(np.diff(x, prepend=0) for x in (upto_a, upto_b, upto)), np.ones(len(units), np.int64)])
        self.sizes.frombytes(counts.astype(np.int64).tobytes())
        self.starts.frombytes((self.starts[-1] + upto).astype(np.int64).tobytes())

    def rows_of(self, texts: list[str]) -> list[list[int]]:
        """The units' rows of each text."""
        if len(self.groups) > MOST_UNITS:
            self.forget()
        cut = [self.units(t) if t else [] for t in texts]
        new = {u for us in cut for u in us if u not in self.known}
        self.learn(list(new))
        rows = [list(map(self.known.__getitem__, us)) for us in cut]
        for u in new:
            if len(u) > LONGEST_UNIT:
                del self.known[u]
        return rows


def ends_open(unit: str) -> bool:
    """Whether what follows a unit may be one with its end."""
    return unit[-1].isspace() or unit[-1] == "▁"


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    """One of a worker process, which lives longer than a task."""
    return Pair(path_a, path_b)


def block_rows(p: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
    """Of a block: columns of its documents; its links (B id and A id), and the document of each."""
    rows = p.rows_of(texts)
    sizes = np.frombuffer(p.sizes, np.int64).reshape(-1, 4)
    starts, links = np.frombuffer(p.starts, np.int64), np.frombuffer(p.links, np.uint64)
    n = np.zeros((len(texts), 3), np.int64)
    digests, found, docs = [], [], []
    for k, own in enumerate(rows):
        at = np.array(own, np.int64)
        if not len(at) or not sizes[at, 3].all():
            digests.append("")
            continue
        n[k] = sizes[at, :3].sum(0)
        digests.append(hashlib.sha256(";".join(map(p.groups.__getitem__, own)).encode()).hexdigest())
        first, many = starts[at], starts[at + 1] - starts[at]
        found.append(links[np.arange(n[k, 2]) + np.repeat(first - (np.cumsum(many) - many), many)])
        docs.append(np.full(n[k, 2], k, np.uint32))
    whole = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return {"n_a": n[:, 0], "n_b": n[:, 1], "n_groups": n[:, 2], "groups_sha256": digests}, whole, np.concatenate(docs) if docs else np.zeros(0, np.uint32)


def by_stripe(links: np.ndarray, docs: np.ndarray, stripes: int, shape: tuple[int, int], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and their documents in order of stripe, B id, A id and document, and where each stripe begins. All four are packed
    into one key, so that plain keys are sorted; keys that have no room for them are sorted by parts."""
    low = np.uint64(0xFFFFFFFF)
    b, a = (links >> np.uint64(32)).astype(np.int64), links & low
    turned = (b % stripes) * (-(-shape[0] // stripes)) + b // stripes
    bits_a, bits_doc = int(shape[1] - 1).bit_length(), int(n_docs - 1).bit_length()
    if int(turned.max(initial=0)).bit_length() + bits_a + bits_doc <= 64:
        keys = np.sort(((turned.astype(np.uint64) << np.uint64(bits_a)) | a) << np.uint64(bits_doc) | docs.astype(np.uint64))
        docs = (keys & np.uint64((1 << bits_doc) - 1)).astype(np.uint32)
        a = (keys >> np.uint64(bits_doc)) & np.uint64((1 << bits_a) - 1)
        turned = (keys >> np.uint64(bits_a + bits_doc)).astype(np.int64)
    else:
        order = np.lexsort((docs, a, turned))
        a, docs, turned = a[order], docs[order], turned[order]
    rows = -(-shape[0] // stripes)
    links = ((turned % rows * stripes + turned // rows).astype(np.uint64) << np.uint64(32)) | a
    return links, docs, np.searchsorted(turned, np.arange(stripes + 1) * rows)


def encoded(rows: DataFrame, path_a: str, path_b: str, stripes: int, block_chars: int) -> DataFrame:
    """Rows of ``BLOCK``. Those of documents have an Arrow table of them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("text").to_pandas().str.len().to_numpy())
            at = 0
            while at < batch.num_rows:
                size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_chars, "right")) - at)
                yield batch.slice(at, size)
                at += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, number = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in blocks(batches):
            columns, links, docs = block_rows(p, batch.column("text").to_pylist())
            sink = pa.BufferOutputStream()
            table = pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in columns.values())], names=["id", *columns])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            made = [(number, -1, len(links), None, None, sink.getvalue().to_pybytes())]
            links, docs, cuts = by_stripe(links, docs, stripes, (p.n_b, p.n_a), batch.num_rows)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = links[cuts[s] : cuts[s + 1]]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                pairs = np.empty(len(first), PAIRS)
                pairs["b"], pairs["a"], pairs["n"] = own[first] >> np.uint64(32), own[first] & np.uint64(0xFFFFFFFF), np.diff(np.append(first, len(own)))
                of = docs[cuts[s] : cuts[s + 1]].astype("<u2" if batch.num_rows <= 1 << 16 else "<u4")
                made.append((number, s, len(own), packed(pairs), bytes([of.itemsize]) + packed(of), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), BLOCK_ARROW)], schema=BLOCK_ARROW)
            number += 1

    return rows.mapInArrow(run, BLOCK)


def partitions(df: DataFrame) -> int:
    """Said outright, since few bytes of pairs are work for many tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense(stripes: int, shape: tuple[int, int]) -> np.ndarray:
    """A stripe's counts: pages that nothing is added to take no memory."""
    return np.zeros((-(-shape[0] // stripes), shape[1]), np.int64)


def cells_of(block: np.ndarray, stripe: int, stripes: int) -> Iterator[np.ndarray]:
    """Cells that are not 0, best ones marked, in arrays of bounded size."""
    best = block.max(axis=1)
    cells = np.flatnonzero(block.reshape(-1))
    for at in range(0, len(cells), MOST_CELLS):
        i, j = np.divmod(cells[at : at + MOST_CELLS], block.shape[1])
        out = np.empty(len(i), CELLS)
        out["b"], out["a"], out["n"] = i * stripes + stripe, j, block[i, j]
        out["best"] = out["n"] == best[i]
        yield out


def added(parts: DataFrame, kind: np.dtype, stripes: int, shape: tuple[int, int], keys: list[str]) -> DataFrame:
    """Sums of the pairs of each stripe (and slot), as cells. Rows stream through the dense block of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, block = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for cells in cells_of(block, now[0], stripes) if block is not None else ():
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([packed(cells)], pa.binary())], names=COUNTS.names)

        for batch in batches:
            for key, data in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("data")):
                if key != now:
                    yield from done()
                    now, block = key, None
                    block = dense(stripes, shape)
                x = unpacked(data.as_py(), kind)
                np.add.at(block, (x["b"] // stripes, x["a"]), x["n"].astype(np.int64))
        yield from done()

    dealt = parts.repartition(partitions(parts), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, COUNTS)


def scored_links(links: DataFrame, counts: DataFrame, stripes: int, shape: tuple[int, int]) -> DataFrame:
    """block, docs: what the links of each row add to its documents. Counts of a slot come before its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, best = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = row["stripe"], row["slot"]
                if key != now:
                    now, block, best = key, None, None
                    block, best = dense(stripes, shape), np.zeros((-(-shape[0] // stripes), shape[1]), bool)
                if row["block"] is None:
                    x = unpacked(row["data"], CELLS)
                    i = x["b"] // stripes
                    block[i, x["a"]] = x["n"]
                    best[i, x["a"]] = x["best"]
                    continue
                x = unpacked(row["data"], PAIRS)
                i, many = x["b"] // stripes, x["n"]
                docs = unpacked(row["docs"][1:], np.dtype(f"<u{row['docs'][0]}")).astype(np.int64)
                n, first = np.repeat(block[i, x["a"]], many), np.repeat(best[i, x["a"]], many)
                order = np.argsort(docs, kind="stable")
                docs = docs[order]
                cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                sums = np.empty(len(cuts), SUMS)
                sums["doc"], sums["best"], sums["sum"] = docs[cuts], np.add.reduceat(first[order].astype(np.int64), cuts), np.add.reduceat(n[order], cuts)
                out.append((row["block"], packed(sums)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=DOCS.names)

    both = links.unionByName(counts, allowMissingColumns=True).repartition(partitions(links), "stripe", "slot").sortWithinPartitions("stripe", "slot", F.col("block").asc_nulls_first())
    return both.mapInArrow(run, DOCS)


def together(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents with the sums of its rows, a row a stripe at most."""
    table, parts = None, []
    for batch in batches:
        for data, docs in zip(batch.column("table"), batch.column("docs")):
            if data.is_valid:
                table = pa.ipc.open_stream(data.as_buffer()).read_all()
            else:
                parts.append(unpacked(docs.as_py(), SUMS))
    best, total = np.zeros((2, table.num_rows), np.int64)
    for x in parts:
        best[x["doc"]] += x["best"]
        total[x["doc"]] += x["sum"]
    c = {n: table.column(n).combine_chunks() for n in table.schema.names}
    yield pa.RecordBatch.from_arrays([c["id"], c["n_a"], c["n_b"], c["n_groups"], c["n_groups"], pa.array(best), pa.array(total), c["groups_sha256"]], names=ALIGNED.names)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = 128, block_chars: int = 3_000_000, slot_links: int = 20_000_000) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    stripes: parts of B's ids, each a dense matrix (some 100 MB at 128, if every pair occurs). block_chars: text whose links
    are packed together. slot_links: links that one task scores with one copy of a stripe's counts.
    """
    p = pair(path_a, path_b)
    shape = (p.n_b, p.n_a)
    rows = spread(docs.select(quoted(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))
    blocks = written(encoded(rows, path_a, path_b, stripes, block_chars), "links")
    links = blocks.filter("stripe >= 0")
    totals = {r["stripe"]: r["n"] for r in links.groupBy("stripe").agg(F.sum("links").alias("n")).collect()}  # a row a stripe
    slots = F.element_at(F.array(*(F.lit(1 + totals.get(s, 0) // slot_links) for s in range(stripes))), F.col("stripe") + 1).cast("int")
    links = links.withColumn("slot", F.pmod(F.xxhash64("block"), slots).cast("int"))
    parts = added(links.select("stripe", "slot", F.col("pairs").alias("data")), PAIRS, stripes, shape, ["stripe", "slot"])
    if any(n >= slot_links for n in totals.values()):
        parts = added(parts.withColumnRenamed("counts", "data"), CELLS, stripes, shape, ["stripe"])
    counts = written(parts, "counts")
    spread_counts = counts.select("stripe", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), F.col("counts").alias("data"))
    sums = scored_links(links.select("stripe", "slot", "block", F.col("pairs").alias("data"), "docs"), spread_counts, stripes, shape)
    tables = blocks.filter("stripe < 0").select("block", "table")
    return tables.unionByName(sums, allowMissingColumns=True).groupBy("block").applyInArrow(together, ALIGNED)
