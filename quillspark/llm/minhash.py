"""MinHash near-duplicate detection with HyperMinHash registers.

A document's set holds its distinct word shingles as 64-bit digests. A sketch has ``bands * rows`` buckets; bucket i keeps
the least value of a 32-bit permutation i over the set, stored as a leading-zero count and ``mantissa`` further bits: 16
bits a bucket. Bands of compressed registers propose candidates, a collision-corrected Jaccard estimate of the whole
registers thins them (by a margin of over four standard errors), and links are confirmed on the full sets.

How the work stays in proportion:

* documents with equal sets form a class at once (grouping by the set's digest, pre-aggregated before the shuffle), and
  everything below works on one representative a class;
* in a band bucket, every member is first compared with one only: the head, the most central member (the one whose
  buckets hold the most). Confirmed links give components;
* members of all buckets with one head may then still be in several components. Those outside the largest are a query
  set: it is laid against all members of the other components in blocks of ``BLOCK``, whose full sets a task compares
  through an inverted index of one block; only confirmed links leave it. No pair is a row, and no link is lost.

Defined cases: ASCII letters are lower-cased; a text with fewer words than a shingle gives its whole word sequence as one
shingle; null and empty texts have an empty set and link with nothing; rows with one id are one document
(where their texts differ, the least set digest stands for them); a null id is never linked; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, LONG, quoted, schema, spread, written
from .components import components

MANTISSA = 10
PAIR = schema(a=LONG, b=LONG)
BLOCK = 256
#: Of the bitmap that says which texts' sets are wanted: two megabytes.
FILTER_WORDS = 1 << 18


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n permutations of the 32-bit integers; the same on every machine."""
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word shingles."""
    words = text.encode().lower().split()  # bytes.split() knows the six ASCII white-space characters only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    runs = zip(*(words[i:] for i in range(size)))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, map(b" ".join, set(runs))), np.uint64))


def registers(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of each bucket's least value, in 16 bits. Equal sets give equal registers."""
    low = ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        block = low[i : i + 256, None] * factors + offsets
        np.minimum(least, block.min(axis=0), out=least)
    width = np.where(least > 0, np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64) + 1, 0)  # bits in use
    zeros = 32 - width
    rest = np.where(width > 0, least.astype(np.int64) - (np.int64(1) << np.maximum(width - 1, 0)), 0)  # without the leading one
    shift = width - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0))
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of disjoint sets of n and m elements agree: the sum over leading-zero counts of both
    being there, over the mantissas."""
    z = np.arange(0, 33)
    hi, lo = 2.0**-z, np.where(z < 32, 2.0 ** -(z + 1.0), 0)
    at = lambda k: (1 - lo) ** k[:, None] - (1 - hi) ** k[:, None]
    return (at(n) * at(m)).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance agreement."""
    same, c = (a == b).mean(axis=1), chance(n.astype(float), m.astype(float))
    return (same - c) / (1 - c)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, n_regs: int) -> DataFrame:
    """id, n, digest of the set, registers. The sets themselves are made again for candidates only."""
    factors, offsets = permutations(n_regs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                batch = big.slice(i, 1000)
                n, digests, regs = [], [], []
                for text in batch.column(1):
                    own = shingles(text.as_py(), size)
                    n.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    regs.append(registers(own, factors, offsets).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "digest", "regs"])

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(sketch, schema(id=LONG, n=LONG, digest=BIN, regs=BIN))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, margin: float = 0.16
) -> DataFrame:
    """(id, n_shingles, component_id): one row per document; component_id is the least id that links reach.

    Documents link if 100 * intersection >= percent * union. With 32 bands of 5 registers a pair at 0.8 is missed with a
    chance of 3e-6; ``margin`` is about five standard errors of 160 registers at 0.8.
    """
    texts = texts_of(docs, id_col, text_col)
    full = written(sketches(docs, id_col, text_col, shingle, bands * rows), "sketches")
    classes = written(full.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    own = classes.groupBy("rep").agg(F.min("digest").alias("own_digest"))
    reps = full.join(own, (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("own_digest"))).select("id", "n", "regs")
    reps = written(reps, "reps")
    buckets = written(headed(band_keys(reps, bands, rows)), "buckets")
    stars = buckets.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(stars, reps, texts, shingle, percent, margin), "links")
    labels = written(components(reps.select("id"), links), "labels")
    more = across(buckets, links, labels, texts, shingle, percent)
    found = components(reps.select("id"), more).withColumnRenamed("id", "node")
    out = full.select("id", "n", "digest").join(classes, "digest", "left").join(found, F.col("rep") == F.col("node"), "left")
    linked = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component"))
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce(linked, F.col("id")).alias("component_id"))


def band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row per document and band: key (band and digest of its registers), id, n."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, bands, rows)
            keys = [xxhash.xxh3_64_intdigest(r[b].tobytes(), seed=b) for r in regs for b in range(bands)]
            ids, n = np.repeat(batch.column(0).to_numpy(), bands), np.repeat(batch.column(1).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids), pa.array(n)], names=["key", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(cut, schema(key=LONG, id=LONG, n=LONG))


def headed(keys: DataFrame) -> DataFrame:
    """key, id, n, head of the buckets with two members or more."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(keys.join(sizes, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("members").alias("central"))
    heads = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("central", "id")).alias("top")).select("key", F.col("top.id").alias("head"))
    return shared.join(heads, "key").select("key", "id", "n", "head")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_WORDS 64-bit words with the hashes of the ids: its size does not depend on how many there are."""
    words = ids.select(F.xxhash64("id").alias("h")).select(F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    set_ = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    return out


def shingle_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, own (digests of the set, sorted as unsigned), written: of all wanted ids, and of the few more that the filter
    lets through. Texts are not shuffled for it; should the filter fill up, sets of all texts are made."""
    bits = texts.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy()
            may = (bits.value[(h >> 6) % FILTER_WORDS] >> (h & 63)) & 1
            batch = batch.filter(pa.array(may == 1))
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), size).view(np.int64) for t in part.column(2)], pa.list_(pa.int64()))], names=["id", "own"])

    hashed = spread(texts.filter("id is not null").select("id", F.xxhash64("id").alias("h"), "text"))
    return written(hashed.mapInArrow(make, schema(id=LONG).add("own", T.ArrayType(LONG))), "sets")


def outside_main(around: DataFrame) -> DataFrame:
    """Rows (head, id, component) of heads with several components, marked where they are not in the largest one."""
    counts = around.groupBy("head", "component").agg(F.count("*").alias("members"))
    main = counts.groupBy("head").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    return around.join(main.select("head", F.col("top.component").alias("main")), "head").withColumn("outside", F.col("component") != F.col("main")).drop("main")


def across(buckets: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``links`` with those between members of one bucket that the comparison with heads left in different components."""
    around = buckets.filter("id <> head").select("head", "id").distinct()
    around = written(outside_main(around.join(labels, "id")), "around")
    own = shingle_sets(texts, around.select("id"), size)
    blocks = around.groupBy("head").agg(F.ceil(F.count_if("outside") / BLOCK).alias("nx"), F.ceil(F.count("*") / BLOCK).alias("ny"))
    dealt = around.join(blocks, "head").join(own, "id")
    h = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    common = ["id", "component", "own"]
    x = dealt.filter("outside").select("head", F.pmod(h, "nx").alias("xb"), every("ny").alias("yb"), F.lit(0).alias("side"), *common)
    y = dealt.select("head", every("nx").alias("xb"), F.pmod(h, "ny").alias("yb"), F.lit(1).alias("side"), *common)
    key = ["head", "xb", "yb"]
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = x.unionByName(y).repartition(parts, *key).sortWithinPartitions(*key, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, kinds, sizes, flat, owner = None, [], [], [], None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            places = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (*block, side), id_, component, own_ in zip(places, batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6)):
                v = own_.values.to_numpy()
                if block != now:
                    now, ids, kinds, sizes, flat, owner = block, [], [], [], [], None
                if side == 0:
                    ids.append(id_)
                    kinds.append(component)
                    sizes.append(len(v))
                    flat.append(v)
                    continue
                if not ids:
                    continue
                if owner is None:  # the first of the other side: the index of this block is complete
                    flat = np.concatenate(flat)
                    order = np.argsort(flat, kind="stable")
                    owner, flat = np.repeat(np.arange(len(ids)), sizes)[order], flat[order]
                    kinds, sizes = np.array(kinds), np.array(sizes)
                lo, hi = np.searchsorted(flat, v, "left"), np.searchsorted(flat, v, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(ids))
                good = (kinds != component) & (100 * both >= percent * (sizes + len(v) - both))
                for k in np.flatnonzero(good):
                    out[0].append(min(ids[k], id_))
                    out[1].append(max(ids[k], id_))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=PAIR.names)

    return written(links.unionByName(sorted_.select(*key, "side", *common).mapInArrow(compare, PAIR)).distinct(), "links")


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, margin: float) -> DataFrame:
    """Pairs (a, b) whose estimate is near the threshold or over, confirmed on the full sets."""
    side = lambda at: reps.select(F.col("id").alias(at), F.col("n").alias(f"n_{at}"), F.col("regs").alias(f"regs_{at}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = near.select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (4, 5))
                good = estimate(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= percent / 100 - margin
                yield batch.select(["a", "b"]).filter(pa.array(good))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (v.values.to_numpy() for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = written(near.mapInArrow(thin, PAIR), "near")
    own = shingle_sets(texts, near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))), size)
    wide = near.join(own.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    return wide.select("a", "b", "own_a", "own_b").mapInArrow(verify, PAIR).distinct()
