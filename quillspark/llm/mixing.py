"""Temperature mixing of sources.

A source's weight is its token share to the power of an exponent, normalised. The exponent lies between 0 (all sources
alike) and 1 (as they are) and is bisected to meet a target: the largest one whose weights reach a share of the greatest
entropy, and not under the smallest one that repeats no source more than a limit. A step of the search evaluates many
exponents in one pass over the source table, which therefore never leaves the executors.

The budget is by default the least that cuts no source: the largest source is passed once, others more often. Weights
become passes: whole ones, then a part. Every pass of a source is a permutation of blocks (documents by hash) and, in
them, of smaller blocks and documents. The part of a pass ends where the budget does: prefix sums over 256 blocks find
the block, over its 256 smaller blocks the smaller one, over that one's documents the place. A source's plan is thus one
row (passes, and the key at which the last one ends), and each document decides by its own key.

Defined cases: tokens are words between white space, and a text without words counts one; null texts are empty; a null
source is a source; null ids and repeated rows are mixed like others (equal rows of one id come and go together); an empty
table gives an empty result; all other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, quoted, spread, written

BLOCKS = 256


def source_tokens(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    return docs.select(quoted(source_col).cast("string").alias("source"), words(quoted(text_col)).alias("n"))


def words(text: F.Column) -> F.Column:
    return F.greatest(F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def exponent(totals: DataFrame, entropy_share: float | None, most_repeats: float | None, budget: float | None, passes: int = 8, grid: int = 16) -> tuple[float, float]:
    """(exponent, sum of token counts to that power). totals: source, tokens."""
    everything = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not everything["n"]:
        return 1.0, 1.0

    def look(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(entropy, repeats of the most repeated source, sum of powers) for each."""
        p = F.col("tokens") / F.lit(float(everything["t"]))
        row = totals.agg(*(F.sum(F.pow(p, F.lit(a))).alias(f"s{i}") for i, a in enumerate(exponents)), *(F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}") for i, a in enumerate(exponents))).first()
        out = []
        for i, a in enumerate(exponents):
            s = row[f"s{i}"]
            entropy = math.log(s) - a * row[f"l{i}"] / s
            share = lambda tokens: (tokens / everything["t"]) ** a / s  # noqa: E731, B023
            size = budget if budget else everything["most"] / share(everything["most"])
            out.append((entropy, size * share(everything["least"]) / everything["least"], s))
        return out

    def search(holds_low: bool, test) -> float:
        """The exponent where test changes: it holds below (or above) that."""
        lo, hi = 0.0, 1.0
        if test(look([1.0])[0]) and holds_low:
            return 1.0
        if test(look([0.0])[0]) and not holds_low:
            return 0.0
        for _ in range(passes):
            points = [lo + (hi - lo) * k / (grid + 1) for k in range(1, grid + 1)]
            good = [test(x) for x in look(points)]
            edge = sum(good) if holds_low else sum(not g for g in good)
            all_ = [lo, *points, hi]
            lo, hi = all_[edge], all_[edge + 1]
        return lo if holds_low else hi

    found = 1.0
    if entropy_share is not None:
        goal = entropy_share * math.log(everything["n"]) - 1e-12
        found = search(True, lambda x: x[0] >= goal)
    elif most_repeats is not None:
        found = 0.0
    if most_repeats is not None:
        found = max(found, search(False, lambda x: x[1] <= most_repeats + 1e-9))
    return found, look([found])[0][2]


def keys(text: F.Column, id_: F.Column, seed: int) -> tuple[F.Column, F.Column, F.Column]:
    """Block, smaller block and document hash of a row."""
    h = F.xxhash64(F.lit(seed), id_, text)
    return F.pmod(h, F.lit(BLOCKS)), F.pmod(F.shiftright(h, 8), F.lit(BLOCKS)), h


def order(pass_: F.Column, *part: F.Column) -> F.Column:
    """Where a block stands in the permutation of a pass."""
    return F.xxhash64(pass_, *part)


def plan(rows: DataFrame, entropy_share: float | None, most_repeats: float | None, budget: float | None) -> DataFrame:
    """source, tokens, goal, passes (whole ones) and the key k1, k2, k3 up to which one more pass goes (null: not at all).

    rows: source, n, b1, b2, h of each document.
    """
    totals = written(rows.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    a, power_sum = exponent(totals, entropy_share, most_repeats, budget)
    t = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    whole = float(t["t"] or 1)
    size = budget if budget else t["most"] and t["most"] * power_sum / (t["most"] / whole) ** a
    goal = F.lit(float(size or 0)) * F.pow(F.col("tokens") / F.lit(whole), F.lit(a)) / F.lit(power_sum)
    plans = totals.withColumn("goal", goal).withColumn("passes", F.floor(F.col("goal") / F.col("tokens") + 1e-9).cast("long"))
    plans = plans.withColumn("rest", F.greatest(F.col("goal") - F.col("passes") * F.col("tokens"), F.lit(0.0))).withColumn("exponent", F.lit(a))
    plans = written(plans, "plans")

    def reached(part: DataFrame, key: F.Column, rest: str) -> DataFrame:
        """The row of each source in which the running sum reaches what is left: its key, and what is left then."""
        w = Window.partitionBy("source").orderBy("key")
        summed = part.withColumn("key", key).withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return summed.filter((F.col("before") < F.col(rest)) & (F.col(rest) <= F.col("before") + F.col("tokens") + 0.5))

    same = lambda left, right: F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
    open_ = plans.filter(F.col("rest") >= 1).select("source", "passes", "rest")
    first = rows.groupBy("source", "b1").agg(F.sum("n").alias("tokens")).alias("r").join(open_.alias("o"), same("r", "o")).select("r.source", "b1", "tokens", "passes", "rest")
    first = reached(first, order(F.col("passes"), F.col("b1")), "rest").groupBy("source").agg(F.min(F.struct("key", "b1", "passes", (F.col("rest") - F.col("before")).alias("rest"))).alias("x"))
    first = written(first.select("source", F.col("x.key").alias("k1"), "x.b1", "x.passes", "x.rest"), "first")
    inside = rows.alias("r").join(first.alias("o"), same("r", "o") & (F.col("r.b1") == F.col("o.b1"))).select("r.source", "r.b1", "b2", "h", "n", "passes", "rest", "k1")
    second = inside.groupBy("source", "b1", "b2", "passes", "rest", "k1").agg(F.sum("n").alias("tokens"))
    second = reached(second, order(F.col("passes"), F.col("b1"), F.col("b2")), "rest").groupBy("source").agg(F.min(F.struct("key", "b1", "b2", "passes", (F.col("rest") - F.col("before")).alias("rest"), "k1")).alias("x"))
    second = written(second.select("source", "x.k1", F.col("x.key").alias("k2"), "x.b1", "x.b2", "x.passes", "x.rest"), "second")
    third = rows.alias("r").join(second.alias("o"), same("r", "o") & (F.col("r.b1") == F.col("o.b1")) & (F.col("r.b2") == F.col("o.b2")))
    third = third.select("r.source", "h", "passes", "rest", "k1", "k2", "n").groupBy("source", "h", "passes", "rest", "k1", "k2").agg(F.sum("n").alias("tokens"))
    third = reached(third, order(F.col("passes"), F.col("h")), "rest").groupBy("source").agg(F.min(F.struct("key", "k1", "k2")).alias("x"))
    ends = third.select("source", "x.k1", "x.k2", F.col("x.key").alias("k3"))
    return written(plans.alias("p").join(ends.alias("e"), same("p", "e"), "left").select("p.source", "tokens", "goal", "exponent", "passes", "k1", "k2", "k3"), "plan")


def mixed(docs: DataFrame, entropy_share: float | None = None, most_repeats: float | None = 2.0, budget: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as it is to be seen, and the columns mix_pass, mix_block, mix_order (the keys by
    which the stream of a source is to be sorted: pass, block, smaller block, document) and mix_tokens."""
    docs = spread(docs)
    text, id_, source = F.coalesce(quoted(text_col).cast("string"), F.lit("")), quoted(id_col).cast("long"), quoted(source_col).cast("string")
    b1, b2, h = keys(text, id_, seed)
    rows = written(docs.select(source.alias("source"), words(text).alias("n"), b1.alias("b1"), b2.alias("b2"), h.alias("h")), "rows")
    todo = plan(rows, entropy_share, most_repeats, budget)
    todo = todo.select(*(F.col(c).alias(f"_plan_{c}") for c in ("source", "passes", "k1", "k2", "k3")))
    joined = docs.join(todo, source.eqNullSafe(F.col("_plan_source")))
    p = F.col("_plan_passes")
    own = F.struct(order(p, b1).alias("k1"), order(p, b1, b2).alias("k2"), order(p, h).alias("k3"))
    last = F.col("_plan_k1").isNotNull() & (own <= F.struct(F.col("_plan_k1").alias("k1"), F.col("_plan_k2").alias("k2"), F.col("_plan_k3").alias("k3")))
    copies = p + F.when(last, 1).otherwise(0)
    at = free_name(docs, "mix_pass")
    seen = joined.withColumn("_copies", copies).filter("_copies > 0").withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    place = F.array(order(F.col(at), b1), order(F.col(at), b1, b2), order(F.col(at), h))
    return seen.select(*(quoted(c) for c in docs.columns), F.col(at), b1.alias(free_name(docs, "mix_block")), place.alias(free_name(docs, "mix_order")), words(text).alias(free_name(docs, "mix_tokens")))


def in_order(seen: DataFrame) -> DataFrame:
    """Rows of ``mixed`` as their sources' streams: by pass, block, smaller block and document. The keys are spread evenly whatever
    the source, so a source with a third of all rows lies in many ranges."""
    n = max(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen.sparkSession.sparkContext.defaultParallelism)
    keys = [quoted("mix_pass"), *(quoted("mix_order")[i] for i in range(3))]
    return seen.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
