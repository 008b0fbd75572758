"""Study statistics: readability, paired runs, variation, agreement, rubric scores and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import SPACE, WORD_CHAR, strip


def prose(text: Column) -> Column:
    """Without fenced blocks."""
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


def loose_semicolons(text: Column) -> Column:
    """Semicolons outside fences and inline code, counted by length."""
    bare = F.regexp_replace(prose(text), r"`[^`]*`", " ")
    return F.length(bare) - F.length(F.replace(bare, F.lit(";"), F.lit("")))


def readability(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with characters, words, semicolons, sentences, words a sentence (mean, most), share of list lines, lines."""
    words = lambda t: F.regexp_count(t, F.lit(rf"{WORD_CHAR}+"))
    body = prose(F.col(column))
    parts = F.filter(F.transform(F.split(body, rf"(?<=[.!?])[{SPACE}]+|\n+"), strip), lambda s: (s != "") & ~s.startswith("#"))
    lines = F.filter(F.split(column, "\n"), lambda x: F.rlike(x, F.lit(rf"[^{SPACE}]")))
    listed = F.filter(lines, lambda x: F.rlike(x, F.lit(rf"^[{SPACE}]*(?:[-*]|\d+[.)])[{SPACE}]+")))
    with_parts = texts.withColumns({"_counts": F.transform(parts, words), "_lines": F.size(lines), "_listed": F.size(listed), "_words": words(body)})
    total = F.aggregate("_counts", F.lit(0), lambda a, x: a + x)
    semis = F.length(body) - F.length(F.replace(body, F.lit(";"), F.lit("")))
    out = {
        "chars": F.length(column), "words": F.col("_words"), "semicolons": semis, "sentence_n": F.size("_counts"),
        "mean_sentence_words": F.coalesce(F.try_divide(total.cast("double"), F.size("_counts").cast("double")), F.lit(0.0)),
        "max_sentence_words": F.coalesce(F.array_max("_counts"), F.lit(0)),
        "list_line_ratio": F.col("_listed") / F.greatest("_lines", F.lit(1)), "lines": F.col("_lines"),
    }
    return with_parts.withColumns(out).drop("_counts", "_lines", "_listed", "_words")


def paired(runs: DataFrame, keys: list[str], condition: str, value: str, control: str, treatment: str) -> DataFrame:
    """A row per key with both arms, their difference, and which arm is missing (null: none)."""
    arms = runs.groupBy(*keys).pivot(condition, [control, treatment]).agg(F.sum(value))
    c, t = F.col(control), F.col(treatment)
    missing = F.when(c.isNull() & t.isNull(), "both").when(c.isNull(), control).when(t.isNull(), treatment)
    return arms.withColumn("delta", t - c).withColumn("missing_arm", missing)


def delta_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.count("missing_arm").alias("incomplete"))


def tally(pairs: DataFrame) -> DataFrame:
    """Wins of the lower value."""
    outcome = F.when(F.col("delta") < 0, "treatment").when(F.col("delta") > 0, "control").when(F.col("delta") == 0, "tie").otherwise("incomplete")
    return pairs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def variation(runs: DataFrame, cell: list[str], condition: str, value: str) -> DataFrame:
    """Mean over cells of the coefficient of variation in per cent, for cells of two runs or more."""
    cells = runs.groupBy(condition, *cell).agg((F.stddev_samp(value) / F.avg(value) * 100).alias("cv"), F.count("*").alias("n")).filter("n >= 2")
    return cells.groupBy(condition).agg(F.avg("cv").alias("mean_cv"), F.count("*").alias("cells"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks, three decimals; null for under three pairs or without variance.

    Ranks come from counts of equal values, which are summed before they are ordered.
    """
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(name: str) -> DataFrame:
        counts = pairs.groupBy(*by, name).agg(F.count("*").alias("ties"))
        before = F.coalesce(F.sum("ties").over(Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(*by, name, (before + (F.col("ties") + 1) / 2).alias(f"rank_{name}"))

    ranked = pairs.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    a, b = F.col(f"rank_{x}"), F.col(f"rank_{y}")
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (F.count("*") >= 3)
    return ranked.groupBy(*by).agg(F.when(varies, F.bround(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), 3)).alias("rho"), F.count("*").alias("n"))


CRITERIA = ("c1", "c2", "c3", "c4")
# The rubric's classes and limits, and the codes of usage flags below.
ACCEPTED, MINOR, MAJOR, BLOCKED = "accepted", "accepted_minor_rework", "rejected_major_rework", "blocked"


def rubric(scores: DataFrame) -> DataFrame:
    """c1 to c4 (0, 1 or 2, else the job fails) and blocked: their sum s, a class, and clarity from 1 to 5."""
    checked = {c: F.when(F.col(c).isin(0, 1, 2), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be 0, 1 or 2")).cast("int")) for c in CRITERIA}
    s = F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")
    zero = F.least(*CRITERIA) == 0
    kind = F.when(F.col("blocked"), BLOCKED).when((s <= 4) | zero, MAJOR).when(s <= 6, MINOR).otherwise(ACCEPTED)
    clarity = F.when(s <= 1, 1).when(s <= 3, 2).when(s == 4, 3).when(s <= 6, 4).otherwise(5)
    return scores.withColumns(checked).withColumns({"s": s, "accept_class": kind, "clarity": clarity})


def preference(a: str, b: str) -> Column:
    """Preferred side ("A", "B" or "tie") of two scored structs: not blocked, higher sum, fewer zeros, then c1, c2, c4, c3."""

    def key(x: str) -> Column:
        one_blocked = F.col(f"{a}.blocked") != F.col(f"{b}.blocked")
        zeros = sum((F.when(F.col(f"{x}.{c}") == 0, 1).otherwise(0) for c in CRITERIA), F.lit(0))
        clear = F.when(one_blocked & ~F.col(f"{x}.blocked"), 1).otherwise(0)
        return F.struct(clear.alias("k0"), F.col(f"{x}.s").alias("k1"), (-zeros).alias("k2"), *(F.col(f"{x}.{c}").alias(f"k{3 + i}") for i, c in enumerate(("c1", "c2", "c4", "c3"))))

    return F.when(key(a) > key(b), "A").when(key(a) < key(b), "B").otherwise("tie")


def anomalies(usage: DataFrame, key: str) -> DataFrame:
    """A row per usage flag. usage: key, input_tokens, output_tokens, total_tokens, model."""
    i, o, t = (F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "total_tokens"))
    flags = F.array(
        F.when((i == 0) & (o == 0) & (t == 0), "tokens_all_zero"),
        F.when((t > 0) & (i + o > 0) & (t > 3 * (i + o)), "total_much_greater_than_in_plus_out"),
        F.when(F.coalesce("model", F.lit("")) == "", "model_missing_in_usage"),
    )
    return usage.select(key, F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("code"))


def normal_usage(usage: DataFrame) -> DataFrame:
    """Token counts under either naming; a missing total is the sum."""
    i, o = F.coalesce("input_tokens", "prompt_tokens", F.lit(0)), F.coalesce("output_tokens", "completion_tokens", F.lit(0))
    return usage.withColumns({"input_tokens": i, "output_tokens": o, "total_tokens": F.coalesce("total_tokens", i + o)}).drop("prompt_tokens", "completion_tokens")


def unanimous(votes: DataFrame, case: str, voters: int = 3) -> DataFrame:
    """Cases that all voters (provider) approved."""
    return votes.groupBy(case).agg((F.bool_and(F.col("decision") == "approve") & (F.count_distinct("provider") == voters)).alias("approved"))


def mcnemar_n(p01: float, p10: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs that McNemar's test needs, by the normal approximation."""
    import math
    from statistics import NormalDist

    z, disc, diff = NormalDist().inv_cdf, p01 + p10, abs(p01 - p10)
    return math.ceil(((z(1 - alpha / 2) * math.sqrt(disc) + z(power) * math.sqrt(disc - diff**2)) / diff) ** 2)


def paired_mde(n: int, sd: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """Least difference that n pairs detect, by the normal approximation."""
    from statistics import NormalDist

    return (NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)) * sd / n**0.5
