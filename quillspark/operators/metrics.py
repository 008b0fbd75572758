"""Evaluation of findings against labelled units: confusion matrices under both conventions, metrics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratio import Z, f1, ratio, wilson

LABELS = ("violation", "non_violation", "out_of_scope", "ambiguous")


def emitted(units: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """``units`` with a flag whether a span was reported for them."""
    hit = spans.select(*on).distinct().withColumn("_hit", F.lit(True))
    return units.join(hit, on, "left").withColumn("emitted", F.col("_hit").isNotNull()).drop("_hit")


def unmatched(spans: DataFrame, units: DataFrame, on: list[str]) -> DataFrame:
    """Reported spans (repeated ones count) that belong to no unit."""
    return spans.join(units.select(*on), on, "left_anti")


def expected_spans(units: DataFrame) -> DataFrame:
    """The span a unit's finding should have: for list units the last character of their lead-in."""
    listed = (F.col("unit_kind") == "list") & (F.col("lead_in_end") > 0)
    return units.withColumn("start", F.when(listed, F.col("lead_in_end") - 1).otherwise(F.col("start"))).withColumn("end", F.when(listed, F.col("lead_in_end")).otherwise(F.col("end")))


def cells(convention: str) -> list[F.Column]:
    """tp, fp, fn, tn of rows (label, emitted).

    strict: ambiguous units are left out. conservative: they count against the rule either way. holdout: as strict, but an
    out-of-scope unit that is not reported is a true negative; in the others it counts only when reported.
    """
    label, hit = F.col("label"), F.col("emitted")
    doubt = (label == "ambiguous") if convention == "conservative" else F.lit(False)
    quiet = label.isin("non_violation", "out_of_scope") if convention == "holdout" else label == "non_violation"
    return [
        F.count_if((label == "violation") & hit).alias("tp"),
        F.count_if((label.isin("non_violation", "out_of_scope") | doubt) & hit).alias("fp"),
        F.count_if(((label == "violation") | doubt) & ~hit).alias("fn"),
        F.count_if(quiet & ~hit).alias("tn"),
    ]


def confusion(units: DataFrame, by: list[str], convention: str, stray: DataFrame | None = None) -> DataFrame:
    """A matrix for each group; ``stray`` (by..., n) adds unmatched findings to fp."""
    out = units.groupBy(*by).agg(*cells(convention))
    if stray is None:
        return out
    return out.join(stray, by, "left").withColumn("fp", F.col("fp") + F.coalesce("n", F.lit(0))).drop("n")


def confusion_with_total(units: DataFrame, domain: str, convention: str = "holdout", stray: int = 0) -> DataFrame:
    """A matrix for each domain and one in total (domain null); unmatched findings count in the total only."""
    out = units.groupingSets([[domain], []], domain).agg(*cells(convention), F.grouping(domain).alias("total"))
    return out.withColumn("fp", F.col("fp") + F.when(F.col("total") == 1, F.lit(stray)).otherwise(0)).drop("total")


def with_metrics(matrix: DataFrame, words: str | None = None, empty: float | None = None) -> DataFrame:
    """Precision and recall with Wilson intervals, F1, and false positives a thousand words where ``words`` names a column."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn)}
    for name, n in (("precision", tp + fp), ("recall", tp + fn)):
        out[f"{name}_low"], out[f"{name}_high"] = wilson(tp, n, empty)
    if words:
        out["fp_per_1000_words"] = ratio(1000 * fp, F.col(words))
    return matrix.withColumns(out)


def extra_hits_needed(matrix: DataFrame, goal: float = 0.95) -> DataFrame:
    """Smallest number of further true positives that lifts the precision interval's low end to the goal (below 1).

    The low end reaches g where k - g n >= z sqrt(n g (1 - g)): a quadratic in sqrt(n). Its root is exact but for rounding, so
    its neighbours are tried on the interval itself.
    """
    tp, fp = F.col("tp"), F.col("fp")
    spread = Z * Z * goal * (1 - goal)
    root = (F.lit(spread**0.5) + F.sqrt(F.lit(spread) + 4 * (1 - goal) * fp)) / (2 * (1 - goal))
    about = F.ceil(root * root - tp - fp).cast("long")
    tried = [F.greatest(about + d, F.lit(0).cast("long")) for d in (-1, 0, 1)]
    return matrix.withColumn("extra_tp", F.coalesce(*(F.when(wilson(tp + x, tp + fp + x)[0] >= goal, x) for x in tried)))


def gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Whether every named metric reaches its limit; a null metric does not."""
    passed = F.lit(True)
    for name, least in limits.items():
        passed = passed & F.coalesce(F.col(name) >= least, F.lit(False))
    return metrics.withColumn("passed", passed)


def agree(left: DataFrame, right: DataFrame, on: list[str], names: list[str], within: float = 1e-15) -> DataFrame:
    """Rows on which two computations of the same metrics differ by more than ``within``, or that one of them lacks."""
    both = left.alias("l").join(right.alias("r"), on, "full_outer")
    same = F.lit(True)
    for n in names:
        x, y = F.col(f"l.{n}"), F.col(f"r.{n}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= within, F.lit(False)))
    return both.filter(~same).select(*on)


def unmatched_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that do not have exactly one row on both sides."""
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), on, "full_outer")
    return both.select(*on, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).filter("n_left <> 1 or n_right <> 1")
