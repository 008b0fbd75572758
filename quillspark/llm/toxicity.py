"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text becomes its character n-grams (``SIZES`` characters, in lower case, within a word and its borders). Over labelled
texts, each n-gram gets the log ratio of its smoothed shares among the n-grams of toxic and of other texts. The n-grams whose
spread over both kinds of texts is the least likely by chance (by likelihood ratio) are the features, each worth its ratio times log(1 + times it is found), and a logistic
regression is fitted to them; the score is its probability.

The classifier is fitted on a bounded sample: at most ``fit_rows`` labelled rows, half of them toxic where there are so many,
those whose ids hash lowest. Rows of the held-out fold are never among them, and neither language, source nor id is a
feature. Counts and feature sets are made by Spark tasks; the driver gets the sample's feature counts (at most ``features``
a text, six bytes each), fits the weights, and sends these out (at most ``features`` of them). Documents are then scored where
they lie, without a shuffle.

Defined cases: a null or empty text has no n-grams and scores what the intercept says; a null id is never in the held-out
fold and has no label; labels other than 0 and 1 are passed over; of several labels of an id the larger holds; repeated rows
are scored each; without labels of both classes every score is the share of toxic ones (0 without any); an empty table gives
no rows; columns of other names are ignored. Long texts are read in slices that overlap. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, BOOL, DBL, INT, LONG, quoted, schema, spread, text_or_empty, written

SIZES = (3, 4, 5, 6, 7)
#: Bits of an n-gram's bucket, and of the part of the buckets that one row of counts holds.
BITS, PART_BITS = 21, 15
SLICE = 1 << 19
#: Other characters than ASCII letters and digits part words, beyond ASCII all characters are letters.
ASCII = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)
SCORED = schema(id=LONG, held_out=BOOL, score=DBL)


def pieces(text: str) -> Iterator[str]:
    """A text in slices that overlap by as much as the longest n-gram needs."""
    more = max(SIZES)
    for at in range(0, max(1, len(text)), SLICE):
        yield text[max(0, at - more) : at + SLICE]


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, with repeats, in arrays of bounded size."""
    for part in pieces(text):
        chars = np.frombuffer(f" {part.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.where(chars < 128, ASCII[np.minimum(chars, 127)], chars)
        gap = chars == 32
        chars = chars[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]
        spaces = np.concatenate([[0], np.cumsum(chars == 32)])
        wide = chars.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        wide ^= wide >> np.uint64(32)
        rolled = wide
        for n in range(2, max(SIZES) + 1):
            if len(chars) < n:
                break
            rolled = rolled[: len(chars) - n + 1] * MIX + wide[n - 1 :]
            if n in SIZES:
                inside = spaces[n - 1 : len(spaces) - 1] == spaces[1 : len(spaces) - n + 1]  # no border but at the ends
                h = rolled[inside]
                yield ((h ^ (h >> np.uint64(29))) * MIX + np.uint64(n) >> np.uint64(64 - BITS)).astype(np.int64)


def features_of(text: str, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features that a text has, ascending, and how often."""
    found = [f[f >= 0] for f in (place[b] for b in buckets(text))]
    return np.unique(np.concatenate([np.zeros(0, place.dtype), *found]), return_counts=True)


def fold(id_col: F.Column) -> F.Column:
    """The held-out third."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """toxic, text of at most ``fit_rows`` labelled rows' texts outside the held-out fold."""
    known = labels.select(quoted(label_id_col).cast("long").alias("label_id"), quoted(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & ~fold(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    first = [F.xxhash64("label_id"), "label_id"]
    toxic = written(known.filter("toxic = 1").orderBy(*first).limit(fit_rows // 2), "toxic")
    other = known.filter("toxic = 0").orderBy(*first).limit(fit_rows - toxic.count())
    chosen = written(toxic.unionByName(other), "chosen")  # bounded, so it may go to all tasks
    rows = docs.select(quoted(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("toxic", "text")


def counted(sample: DataFrame) -> DataFrame:
    """part, n: how many toxic and other texts have each n-gram, as two arrays of 32-bit counts a part of the buckets."""
    width = 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found = list(buckets(text))
                if found:
                    have[toxic][np.unique(np.concatenate(found))] += 1
        for part in range(1 << (BITS - PART_BITS)):
            own = np.ascontiguousarray(have[:, part * width : (part + 1) * width])
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [own.tobytes()]})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, np.int32)
        for batch in batches:
            for data in batch.column("n"):
                total += np.frombuffer(data.as_py(), np.int32)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "n": [total.tobytes()]})

    shape = schema(part=INT, n=BIN)
    return sample.mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape)


def surprise(n: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of counts by class (rows) against counts in proportion to the classes' texts."""
    held, rest = n.sum(0), texts.sum() - n.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return sum(np.nan_to_num(x * np.log(x / (own * m / texts.sum()))) for m, k in zip(texts, n) for x, own in ((k, held), (m - k, rest)))


def ratios(counts: DataFrame, texts: np.ndarray, least: int, alpha: float, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features, ascending, and their log-count ratios."""
    shape = schema(toxic=LONG, other=LONG)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.frombuffer(d.as_py(), np.int32).reshape(2, -1).sum(1, dtype=np.int64) for d in batch.column("n")]
            yield pa.RecordBatch.from_arrays([pa.array([int(s[k]) for s in sums], pa.int64()) for k in (1, 0)], names=shape.names)

    sums = counts.mapInArrow(add, shape).agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first()
    total = np.array([sums[1], sums[0]], float) + alpha * (1 << BITS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("n")):
                n = np.frombuffer(data.as_py(), np.int32).reshape(2, -1).astype(float)
                ratio = np.log((n[1] + alpha) / total[1]) - np.log((n[0] + alpha) / total[0])
                own = np.flatnonzero(n.sum(0) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(own + (part << PART_BITS), pa.int64()), pa.array(ratio[own]), pa.array(surprise(n[:, own], texts))], names=["bucket", "ratio", "far"])

    found = counts.mapInArrow(choose, schema(bucket=LONG, ratio=DBL, far=DBL)).orderBy(F.col("far").desc(), "bucket").limit(features).toArrow()
    bucket, ratio = found.column("bucket").to_numpy(), found.column("ratio").to_numpy()
    order = np.argsort(bucket)
    return bucket[order], ratio[order]


def logistic(rows: np.ndarray, values: np.ndarray, starts: np.ndarray, y: np.ndarray, n: int, scale: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Weights of ``n`` features and of the intercept, by L-BFGS on the mean log loss with an L2 penalty. ``rows`` are feature
    numbers of all texts, each text's from ``starts[k]`` to ``starts[k + 1]``."""
    blocks = [(a, min(a + 1024, len(y))) for a in range(0, len(y), 1024)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        worth, value, grad, rest = w[:-1] * scale, 0.0, np.zeros(n), 0.0
        for a, b in blocks:
            own, value_of = rows[starts[a] : starts[b]], values[starts[a] : starts[b]]
            sums = np.concatenate([[0.0], np.cumsum(worth[own] * value_of)])
            z = sums[starts[a + 1 : b + 1] - starts[a]] - sums[starts[a:b] - starts[a]] + w[-1]
            value += np.logaddexp(0, np.where(y[a:b], -z, z)).sum()
            off = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[a:b]
            grad += np.bincount(own, np.repeat(off, np.diff(starts[a : b + 1])) * value_of, n)
            rest += off.sum()
        m = len(y)
        return value / m + penalty / 2 * (w[:-1] @ w[:-1]), np.append(grad * scale / m + penalty * w[:-1], rest / m)

    w = np.zeros(n + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = grad.copy(), []
        for s, d in reversed(past):
            kept.append((s @ way) / (s @ d))
            way -= kept[-1] * d
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, d), a in zip(past, reversed(kept)):
            way += (a - (d @ way) / (s @ d)) * s
        size = 1.0 if past else 1 / max(1.0, np.linalg.norm(grad))
        while True:
            new = w - size * way
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * size * (grad @ way) or size < 1e-8:
                break
            size /= 2
        s, d = new - w, new_grad - grad
        done = value - new_value < 1e-7
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d)]
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def fitted(sample: DataFrame, features: int, least: int, alpha: float, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets of the features, what each adds to the log odds, and the intercept."""
    spark = sample.sparkSession
    sample = written(sample, "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.int64), np.zeros(0), 60.0 if sizes.get(1) else -60.0
    dealt = spread(sample)
    bucket, ratio = ratios(written(counted(dealt), "counts"), np.array([sizes[0], sizes[1]], float), least, alpha, features)
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    shared = spark.sparkContext.broadcast(place)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t, shared.value) for t in batch.column("text").to_pylist()]
            own = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in enumerate(("<u2", "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *own], names=["toxic", "found", "times"])

    rows = dealt.mapInArrow(sets, schema(toxic=INT, found=BIN, times=BIN)).toArrow()
    y = rows.column("toxic").to_numpy().astype(bool)
    found, times = (np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), kind) for c, kind in (("found", "<u2"), ("times", "<f4")))
    starts = np.concatenate([[0], np.cumsum([len(x.as_py()) // 2 for x in rows.column("found")])])
    w = logistic(found, np.log1p(times), starts, y, len(bucket), ratio, penalty, steps)
    return bucket, w[:-1] * ratio, float(w[-1])


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", threshold: float = 0.7,
    fit_rows: int = 20_000, features: int = 1 << 11, least: int = 3, alpha: float = 0.5, penalty: float = 1e-4, steps: int = 100,
) -> DataFrame:
    """id, held_out, score and predicted of every document.

    least: labelled texts that a feature must be in. alpha: what is added to each count. features: 65,536 at most.
    """
    spark = docs.sparkSession
    if features > 1 << 16:
        raise ValueError("feature numbers are kept in 16 bits")
    bucket, worth, intercept = fitted(fit_sample(docs, labels, id_col, text_col, label_id_col, label_col, fit_rows), features, least, alpha, penalty, steps)
    model = spark.sparkContext.broadcast((bucket, worth, intercept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value, add = model.value
        place = np.full(1 << BITS, -1, np.int32)
        place[own] = np.arange(len(own))
        for batch in batches:
            found = (features_of(t, place) for t in batch.column("text").to_pylist())
            odds = np.array([add + (value[f] * np.log1p(n)).sum() for f, n in found])
            chance = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(chance, pa.float64())], names=SCORED.names)

    rows = spread(docs.select(quoted(id_col).cast("long").alias("id"), fold(quoted(id_col).cast("long")).alias("held_out"), text_or_empty(text_col).alias("text")))
    return rows.mapInArrow(score, SCORED).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
