"""Quality rules: text statistics, and robust multivariate outliers by language and source.

``text_stats`` reads every whole text. ``outliers`` estimates, for each language and source, a centre and covariance by the
minimum covariance determinant: from coordinatewise medians, concentration steps refit to the rows that lie nearest until
the steps end, each step one pass of sums formed before the shuffle. A little of the scale is added to the diagonal, for
coordinates that hardly vary. A document is rejected by its Mahalanobis distance, scaled so that the median of a group has
the chi-square median, where that lies beyond the chi-square tail and beyond the group's own: a normal tail of its unsquared
distances, from their median and upper quartile. No limit comes from given tables.

The statistics are transformed to be near symmetric: log words, log mean word length, log symbols a word, roots of the
shares of capitals, of punctuation, of characters in duplicate lines and of words in repeated windows. Short texts scatter more than long
ones, so their deviations are divided by what a mean over so few words scatters more. Scales have floors, since a source may
write one length of word only.

Defined cases: null and empty texts have no words and fail the base rules; rows that fail them take no part in estimates;
null languages and sources are groups of their own; a group with under ``min_rows`` rows is measured by the estimate of its
whole language, and where that is small, of all rows; where even those are few, nothing is rejected; repeated rows get equal results; an empty table gives an empty
result; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, STR, free_name, quoted, schema, spread, written

SYMBOLS, BLANKS, PUNCT = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b".,;:!?"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least scale of each coordinate: log words, log mean length, log symbols, root capitals, root punctuation, root duplicate
#: lines, root repeated words.
FLOORS = (0.5, 0.05, 0.1, 0.02, 0.02, 0.4, 0.4)


def chi2(share: float, k: int = len(FLOORS)) -> float:
    """Quantile of chi-square with k degrees of freedom (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(share) * (2 / (9 * k)) ** 0.5) ** 3


CHI2_MEDIAN = chi2(0.5)


def in_repeated_windows(words: list[bytes]) -> int:
    """How many words lie in a window of three that stands twice or more. Windows are numbers: no objects for each place."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # else three numbers fit one
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    hit, covered = times[which] > 1, np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(hit) + k] |= hit
    return int(covered.sum())


def stats_of(text: str) -> tuple[int, ...]:
    """The five counts, then ASCII capitals, punctuation, and characters in duplicate lines."""
    data = text.encode()
    words = data.split()
    without = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    seen, twice = set(), 0
    for line in lines:
        if line in seen:
            twice += len(line.translate(None, BLANKS).decode())
        seen.add(line)
    repeated = in_repeated_windows(words)
    return len(words), len(text) - without(BLANKS), without(SYMBOLS), len(lines) - len(seen), repeated, without(CAPITALS), without(PUNCT), twice


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, text_hash, lang, source, the five counts, base_failed and the coordinates f0 to f6: a row per document."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    kept = spread(docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), quoted(lang_col).cast("string").alias("lang"), quoted(source_col).cast("string").alias("source"), text.alias("text")))
    names = (*COUNTS, "n_capitals", "n_punct", "dup_chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([stats_of(t.as_py()) for t in batch.column(4)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(c) for c in found.T], names=["id", "text_hash", "lang", "source", *names])

    counted = kept.mapInArrow(count, schema(id=LONG, text_hash=LONG, lang=STR, source=STR, **dict.fromkeys(names, LONG)))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "id", "text_hash", "lang", "source", *COUNTS,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(words.cast("double")).alias("f0"),
        F.log(chars / words).alias("f1"),
        F.log1p(10 * F.col("n_symbols") / words).alias("f2"),
        F.sqrt(F.col("n_capitals") / chars).alias("f3"),
        F.sqrt(F.col("n_punct") / chars).alias("f4"),
        F.sqrt(F.col("dup_chars") / chars).alias("f5"),
        F.sqrt(F.col("n_repeat_words") / words).alias("f6"),
    )


P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
PARAMS = schema(group=STR, **{f"m{i}": DBL for i in range(P)}, **{f"p{i}{j}": DBL for i, j in PAIRS})


def fitted(moments: DataFrame, ridge: float) -> DataFrame:
    """Centre and precision of each group from its count, sums and sums of products."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in batch.schema.names if c != "group"}
            out = {c: [] for c in PARAMS.names[1:]}
            for k in range(batch.num_rows):
                n = x["n"][k]
                mean = np.array([x[f"s{i}"][k] for i in range(P)]) / n
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = x[f"s{i}{j}"][k] / n - mean[i] * mean[j]
                inverse = np.linalg.inv(cov + ridge * np.eye(P))
                for i in range(P):
                    out[f"m{i}"].append(mean[i])
                for i, j in PAIRS:
                    out[f"p{i}{j}"].append(inverse[i, j])
            yield pa.RecordBatch.from_arrays([batch.column("group")] + [pa.array(v, pa.float64()) for v in out.values()], names=PARAMS.names)

    return moments.mapInArrow(fit, PARAMS)


def distance() -> F.Column:
    return sum(((1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"z{i}") - F.col(f"m{i}")) * (F.col(f"z{j}") - F.col(f"m{j}")) for i, j in PAIRS), F.lit(0.0))


def standing(i: int) -> F.Column:
    """A coordinate from its group's centre. A mean or share of n words scatters with 1 / sqrt(n): what a text shorter than
    the group's median has is brought to that length."""
    short = F.least(F.exp((F.col("f0") - F.col("c0")) / 2), F.lit(1.0)) if i else F.lit(1.0)
    return (F.col(f"f{i}") - F.col(f"c{i}")) * short


def outliers(stats: DataFrame, keep_share: float = 0.75, steps: int = 8, ridge: float = 0.05, level: float = 1e-4, min_rows: int = 100, least_rows: int = 20) -> DataFrame:
    """``stats`` with group, distance (squared; null without an estimate) and rejected.

    keep_share: rows of a group that concentration steps fit to. level: share of good documents that may lie beyond each
    of the two tails.
    """
    good = stats.filter(~F.col("base_failed"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    both, one = F.concat_ws("\x1f", named("lang"), named("source")), named("lang")
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("m"))
    small, few = F.col("n") < min_rows, F.col("m") < min_rows
    sizes = sizes.join(whole, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    sizes = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.when(~small, both).when(~few, one).otherwise("all").alias("group"), "n", "m")
    sizes = written(sizes, "groups")
    asked = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.bool_or(few), F.lit(False)).alias("all")).first()
    #: Tables with a row a group go to all tasks while groups are few (some 400 bytes each); beyond, they are joined by group.
    beside = F.broadcast if asked["groups"] <= 20_000 else (lambda df: df)
    grouped = stats.join(beside(sizes.select("l", "s", "group")), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    grouped = written(grouped, "grouped")

    # a row takes part in the estimate of its own group and, where small groups ask for them, in those of its language and of all
    fit_rows = grouped.filter(~F.col("base_failed"))
    languages = sizes.filter(small & ~few).select(F.col("l").alias("asks")).distinct()
    in_language = fit_rows.filter(F.col("group") != one).join(beside(languages), F.col("lang").eqNullSafe(F.col("asks")), "left_semi").withColumn("group", one)
    parts = [fit_rows, in_language, *([fit_rows.filter(F.col("group") != "all").withColumn("group", F.lit("all"))] if asked["all"] else [])]
    fit_rows = reduce(DataFrame.unionByName, parts)
    middle = fit_rows.groupBy("group").agg(F.count("*").alias("rows"), *(F.percentile_approx(f"f{i}", 0.5).alias(f"c{i}") for i in range(P))).filter(F.col("rows") >= least_rows)
    middle = written(middle, "middle")
    spreads = fit_rows.join(beside(middle), "group").groupBy("group").agg(*(F.percentile_approx(F.abs(standing(i)), 0.5).alias(f"a{i}") for i in range(P)))
    scale = written(middle.join(spreads, "group").drop("rows"), "scale")
    z = [(standing(i) / F.greatest(F.lit(1.4826) * F.col(f"a{i}"), F.lit(FLOORS[i]))).alias(f"z{i}") for i in range(P)]
    rows = written(fit_rows.join(beside(scale), "group").select("group", *z), "standard")

    d = sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))
    params = None
    for _ in range(steps):
        measured = rows.withColumn("d", d) if params is None else rows.join(beside(params), "group").withColumn("d", distance())
        cut = measured.groupBy("group").agg(F.percentile_approx("d", keep_share).alias("cut"))
        near = measured.join(beside(cut), "group").filter("d <= cut")
        moments = near.groupBy("group").agg(F.count("*").alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in PAIRS))
        params = written(fitted(moments, ridge), "params")
    measured = rows.join(beside(params), "group").withColumn("d", distance())
    middle_d = measured.groupBy("group").agg(F.percentile_approx("d", [0.5, 0.75]).alias("q"))
    middle_d = middle_d.select("group", F.col("q")[0].alias("half"), (F.sqrt(F.col("q")[1] / F.greatest(F.col("q")[0], F.lit(1e-9))) - 1).alias("upper"))
    beyond = NormalDist().inv_cdf(1 - level) / NormalDist().inv_cdf(0.75)
    limit = F.greatest(F.lit(chi2(1 - level)), F.lit(CHI2_MEDIAN) * F.pow(1 + F.lit(beyond) * F.col("upper"), F.lit(2.0)))
    fit = written(scale.join(params, "group").join(middle_d.withColumn("limit", limit), "group"), "fit")
    out = grouped.join(beside(fit), "group", "left")
    out = out.select(*grouped.columns, *z, *fit.columns[1:])
    squared = distance() / F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1e-9))
    out = out.withColumn("distance", F.when(~F.col("base_failed"), squared))
    return out.select(*grouped.columns, "distance", "limit", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False)).alias("rejected"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base_failed, distance and kept of every document."""
    stats = written(text_stats(docs, id_col, text_col, lang_col, source_col), "stats")
    return outliers(stats).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns."""
    bad = verdicts(docs, id_col, text_col, lang_col, source_col).filter(~F.col("kept")).select(F.col("id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    mark = free_name(docs, "_hash")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))
    return marked.join(bad, quoted(id_col).cast("long").eqNullSafe(F.col("_bad_id")) & (F.col(mark) == F.col("_bad_hash")), "left_anti").drop(mark)
