"""Reviews: labels that rules propose, decisions that must be consistent, agreement of reviewers, and ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import is_iso_date
from ..functions.chars import SPACE
from .inventory import positioned
from .study import spearman

# Truths, the truths of each record type, the diagnostics that each expects, and the regions where each lies.
TRUTHS = ("violation", "non_violation", "out_of_scope", "ambiguous")
ALLOWED = {"literal_semicolon": ("violation", "out_of_scope", "ambiguous"), "zero_semicolon_control": ("non_violation",)}
EXPECTED = {"violation": 1, "non_violation": 0, "out_of_scope": 0, "ambiguous": None}
EXCLUDED_REGIONS = ("fenced_code", "inline_code", "link_destination_or_url", "metadata", "markup_or_attribute")
SEVERITIES = ("none", "minor", "major", "blocker")
DECISION_FIELDS = ("domain", "truth", "structural_region", "expected_diagnostics", "rationale", "review_status", "reviewed_by", "reviewer_role", "reviewed_on", "decision_notes")


def blank(name: str) -> Column:
    return ~F.rlike(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(rf"[^{SPACE}]"))


def is_in(name: str, values: tuple) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def fits_type() -> Column:
    return reduce(lambda a, b: a | b, ((F.col("record_type") == k) & is_in("truth", v) for k, v in ALLOWED.items()))


def expects(as_text: bool) -> Column:
    """Whether the expected diagnostics are those of the truth; as text, none are an empty one."""
    value = F.col("expected_diagnostics")
    one = lambda n: (value == F.lit("" if n is None else str(n))) if as_text else value.eqNullSafe(F.lit(n).cast("int"))
    return reduce(lambda a, b: a | b, ((F.col("truth") == k) & one(n) for k, n in EXPECTED.items()))


def decision_constraints() -> dict[str, Column]:
    """What a person's decision (texts) must keep; each condition tells of a breach."""
    approved, rejected = F.col("review_status") == "approved", F.col("review_status") == "rejected"
    padded = reduce(lambda a, b: a | b, (F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(rf"^[{SPACE}]|[{SPACE}]$")) for c in DECISION_FIELDS))
    lacks = lambda names: reduce(lambda a, b: a | b, map(blank, names))
    full = approved & ~lacks(("truth",))
    return {
        "padded": padded, "not_reviewed": ~is_in("review_status", ("approved", "rejected")), "reviewer": (approved | rejected) & lacks(("reviewed_by", "reviewer_role", "reviewed_on")),
        "date": (approved | rejected) & ~blank("reviewed_on") & ~is_iso_date(F.col("reviewed_on")), "notes": rejected & blank("decision_notes"),
        "fields": approved & lacks(("domain", "truth", "structural_region", "rationale")), "record_type": approved & ~is_in("record_type", tuple(ALLOWED)),
        "truth": full & is_in("record_type", tuple(ALLOWED)) & ~fits_type(), "expected": full & is_in("truth", TRUTHS) & ~expects(True),
    }


def structured_constraints() -> dict[str, Column]:
    """What a model's structured review must keep: truth, region, expected diagnostics, and that doubt goes to a person."""
    region, truth, human = F.col("structural_region"), F.col("truth"), F.col("requires_human")
    fits = ((truth == "violation") & (region == "visible_prose")) | ((truth == "out_of_scope") & region.isin(*EXCLUDED_REGIONS)) | ((truth == "ambiguous") & (region == "ambiguous")) | ((truth == "non_violation") & (region == "document_control"))
    critical = (truth == "ambiguous") | ~F.col("confidence").eqNullSafe("high")
    return {
        "record_type": ~is_in("record_type", tuple(ALLOWED)), "truth": is_in("record_type", tuple(ALLOWED)) & ~fits_type(), "expected": ~expects(False), "region": ~fits, "rationale": blank("rationale"),
        "not_escalated": critical & ~human.eqNullSafe(True), "reason_without_need": human.eqNullSafe(False) & ~F.col("critical_reason").eqNullSafe("none"), "need_without_reason": human.eqNullSafe(True) & (F.col("critical_reason") == "none"),
    }


def vote_constraints() -> dict[str, Column]:
    """What a panel's vote on a case must keep."""
    approve, fields = F.col("decision") == "approve", F.coalesce(F.size("fields"), F.lit(0))
    return {
        "decision": ~is_in("decision", ("approve", "change_required")), "severity": ~is_in("severity", SEVERITIES), "fields": F.coalesce(F.exists("fields", lambda f: F.trim(f) == ""), F.lit(False)),
        "approval": approve & ((F.col("severity") != "none") | (fields > 0) | (F.coalesce("proposed_change", F.lit("")) != "")),
        "request": (F.col("decision") == "change_required") & ((F.col("severity") == "none") | (fields == 0) | blank("rationale") | blank("proposed_change")),
    }


def checked(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Rows with ``faults``: the codes of all constraints that they break, in the order declared. A condition that is null is
    no breach. All constraints are one expression: one pass, no shuffle."""
    return rows.withColumn("faults", F.array_compact(F.array(*(F.when(c, k) for k, c in constraints.items()))))


def review_summary(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """One row: cases, duplicate ids, approved, rejected, faulty, and approved decisions by truth."""
    approved = F.col("review_status") == "approved"
    sums = checked(rows, constraints).agg(
        F.count("*").alias("cases"), (F.count("*") - F.count_distinct("case_id")).alias("duplicates"), F.count_if(approved).alias("approved"), F.count_if(F.col("review_status") == "rejected").alias("rejected"),
        F.count_if(F.size("faults") > 0).alias("faulty"), *(F.count_if(approved & (F.col("truth") == t)).alias(t) for t in TRUTHS),
    )
    return sums


def fault_counts(rows: DataFrame, constraints: dict[str, Column], by: list[str]) -> DataFrame:
    """``by``, fault, n."""
    return checked(rows, constraints).select(*by, F.explode("faults").alias("fault")).groupBy(*by, "fault").agg(F.count("*").alias("n"))


# --- labels that rules propose -------------------------------------------------------------------------------------------------------

#: "... these <plural>." or ":" at the end of a line.
ASSOCIATION = r"(?i)(?<![\p{L}\p{N}_])these[ \t]+\p{L}+(?:-\p{L}+)*s([.:])$"


def list_label(lead_in: Column) -> Column:
    """Label of a list run (columns of ``projection.list_units``) whose lead-in text is given."""
    last = F.regexp_replace(F.substring_index(F.regexp_replace(lead_in, r"[\r\n]+$", ""), "\n", -1), r"\r$", "")
    end = F.regexp_extract(last, ASSOCIATION, 1)
    apart = (F.size("blockers") > 0) | ~F.col("blank_lines").between(0, 1) | ~F.col("indentation").between(0, 3) | (F.col("peers") < 2)
    return F.when(F.col("lead_in_status") == "uncertain", "ambiguous").when((F.col("lead_in_status") != "found") | apart | (end == ""), "out_of_scope").when(end == ".", "violation").otherwise("non_violation")


def paragraph_label(sentences: Column, limit: int = 6, excluded: Column | None = None) -> Column:
    """Label of a paragraph (structural_context) by the number of its sentences."""
    out = F.lit(False) if excluded is None else excluded
    return F.when(F.col("structural_context") == "uncertain", "ambiguous").when((F.col("structural_context") != "visible_prose") | out | (sentences == 0), "out_of_scope").when(sentences <= limit, "non_violation").otherwise("violation")


def punctuation_label(reviewed: Column) -> Column:
    """Label of a semicolon: what is visible must be reviewed and what is markup must not; anything else fails the job."""
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("case_id"))).cast("string")
    visible = F.when(reviewed, "violation").otherwise(wrong("visible but not reviewed"))
    markup = F.when(reviewed, wrong("reviewed but markup")).otherwise("non_violation")
    return F.when(F.col("structural_context") == "visible_prose", visible).when(F.col("structural_context") == "markup_or_code", markup).otherwise(wrong("needs a decision"))


def sentence_labels(units: DataFrame, sets: dict[str, DataFrame], excluded: Column | None = None) -> DataFrame:
    """Units (case_id, structural_context, sentence_status) with a label: uncertain ones are ambiguous, incomplete, excluded and
    listed ones out of scope, the others as the sets (label to case_id) say, or no violation. Sets that share a case fail."""
    marks = memberships({k: v.select("case_id") for k, v in sets.items()}, "case_id")
    names = list(sets)
    clash = F.raise_error(F.concat(F.lit("reviewed sets overlap: "), F.col("case_id"))).cast("string")
    said = F.when(F.bit_count("mask") > 1, clash)
    for i, k in enumerate(names):
        said = said.when(F.col("mask") == 1 << i, k)
    met = units.join(marks, "case_id", "left").withColumn("_said", said)
    out = F.lit(False) if excluded is None else excluded
    label = F.when(F.col("structural_context") == "uncertain", "ambiguous").when((F.col("structural_context") != "visible_prose") | (F.col("sentence_status") != "complete") | out, "out_of_scope")
    return met.withColumn("label", label.otherwise(F.coalesce("_said", F.lit("non_violation")))).drop("mask", "_said")


# --- sets, agreement, ground truth ---------------------------------------------------------------------------------------------------


def memberships(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key, mask: bit i is set where the i-th set holds the key. One grouping for any number of sets (62 at most)."""
    marked = [df.select(F.col(key), F.lit(1 << i).cast("long").alias("mask")) for i, df in enumerate(sets.values())]
    return reduce(DataFrame.unionByName, marked).groupBy(key).agg(F.bit_or("mask").alias("mask"))


def shared_keys(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """left, right, shared: how many keys each pair of sets has in common; pairs that are disjoint are not listed. Masks are
    counted before pairs are made, so pairs are made of at most as many rows as there are masks."""
    names = list(sets)
    masks = memberships(sets, key).groupBy("mask").agg(F.count("*").alias("n")).filter(F.bit_count("mask") > 1)
    pairs = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit((1 << i) | (1 << j)).cast("long").alias("both")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j))
    rows = masks.select("mask", "n", F.explode(pairs).alias("p")).filter(F.col("mask").bitwiseAND(F.col("p.both")) == F.col("p.both"))
    return rows.groupBy("p.left", "p.right").agg(F.sum("n").alias("shared"))


def artifact_scores(key: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Artifacts (label, case_id, condition, model) that both reviewers scored, with their columns as structs a and b."""
    side = lambda df, name: df.select("label", F.struct(*(c for c in df.columns if c != "label")).alias(name))
    return key.join(side(first, "a"), "label").join(side(second, "b"), "label")


def preferred(pairs: DataFrame, side: str, better: list[Column]) -> Column:
    """Which condition a reviewer prefers, by the first of some differences (treatment less control) that is not 0."""
    out = F.lit("tie")
    for d in reversed(better):
        out = F.when(d > 0, "treatment").when(d < 0, "control").otherwise(out)
    return out


def preferences(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by``, pref_a, pref_b of pairs that have both conditions: reviewer a goes by clarity, then by fewer findings; b by not
    being blocked, then by the sum s."""
    one = lambda condition: F.max(F.when(F.col("condition") == condition, F.struct("a", "b")))
    pairs = scores.groupBy(*by).agg(one("control").alias("c"), one("treatment").alias("t")).filter("c is not null and t is not null")
    blocked = F.col("c.b.blocked").cast("int") - F.col("t.b.blocked").cast("int")
    a = preferred(pairs, "a", [F.col("t.a.clarity") - F.col("c.a.clarity"), F.col("c.a.findings") - F.col("t.a.findings")])
    b = preferred(pairs, "b", [blocked, F.col("t.b.s") - F.col("c.b.s")])
    return pairs.select(*by, a.alias("pref_a"), b.alias("pref_b"))


def agreement(scores: DataFrame) -> DataFrame:
    """One row: artifacts, the share on whose class both agree, and the rank correlations of clarity and of findings."""
    rows = scores.select(F.lit(0).alias("all"), F.col("a.clarity").alias("ca"), F.col("b.clarity").alias("cb"), F.col("a.findings").alias("fa"), F.col("b.findings").alias("fb"), (F.col("a.accept_class") == F.col("b.accept_class")).alias("same"))
    rate = rows.groupBy("all").agg(F.count("*").alias("artifacts"), F.round(F.avg(F.col("same").cast("double")), 3).alias("class_agreement"))
    rhos = [spearman(rows, x, y, ["all"]).select("all", F.col("rho").alias(n)) for x, y, n in (("ca", "cb", "clarity_rho"), ("fa", "fb", "findings_rho"))]
    return rate.join(rhos[0], "all", "left").join(rhos[1], "all", "left").drop("all")


def leave_one_out(prefs: DataFrame, case: str) -> DataFrame:
    """case, pairs, agreed, rate of all pairs but those of the case; the row with a null case is of all. Sums of the cases are
    taken from the sum of all, so the pairs are read once."""
    same = F.col("pref_a") == F.col("pref_b")
    own = prefs.groupBy(case).agg(F.count("*").alias("n"), F.count_if(same).alias("k"))
    total = own.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    without = own.join(F.broadcast(total)).select(case, (F.col("all_n") - F.col("n")).alias("pairs"), (F.col("all_k") - F.col("k")).alias("agreed"))
    all_ = total.select(F.lit(None).cast(own.schema[case].dataType).alias(case), F.col("all_n").alias("pairs"), F.col("all_k").alias("agreed"))
    both = without.unionByName(all_)
    return both.withColumn("rate", F.round(F.try_divide(F.col("agreed").cast("double"), F.col("pairs").cast("double")), 3))


def verdict(rate: Column, rho: Column) -> Column:
    """What agreement of preferences and of clarity ranks amounts to."""
    return F.when((rate >= 2 / 3) & (F.coalesce(rho, F.lit(0.0)) >= 0.5), "convergent").when(rate >= 1 / 3, "mixed").otherwise("inconclusive")


def condition_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by``, condition, means of reviewer b's sum, clarity and findings, two decimals."""
    mean = lambda c: F.round(F.avg(F.col(f"b.{c}")), 2).alias(f"mean_{c}")
    return scores.groupBy(*by, "condition").agg(*map(mean, ("s", "clarity", "findings")), F.count("*").alias("n"))


def findings_summary(findings: DataFrame, by: list[str], categories: list[str]) -> DataFrame:
    """``by``, findings, major, minor (whatever is not major), and a count of each category."""
    major = F.count_if(F.col("severity") == "major")
    return findings.groupBy(*by).agg(F.count("*").alias("findings"), major.alias("major"), (F.count("*") - major).alias("minor"), *(F.count_if(F.col("category") == c).alias(c) for c in categories))


def panel_totals(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, calls and errors of reviews (usage, error): one with an error and no usage is no call."""
    failed = F.col("error").isNotNull() & F.col("usage").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(~failed, F.coalesce(F.col(f"usage.{c}"), F.lit(0)))), F.lit(0)).alias(c)
    return reviews.groupBy(*by).agg(*map(total, ("input_tokens", "output_tokens", "total_tokens")), F.count_if(~failed).alias("calls"), F.count_if(failed).alias("errors"))


def unblinded(scores: DataFrame, key: DataFrame) -> DataFrame:
    """Scores (case_id, label, ...) with the condition that their label stands for; a score without one is dropped by no means:
    it fails the job."""
    met = scores.join(key.select("case_id", "label", "condition"), ["case_id", "label"], "left")
    lost = F.raise_error(F.concat(F.lit("no condition: "), F.col("case_id"), F.lit("/"), F.col("label"))).cast("string")
    return met.withColumn("condition", F.coalesce("condition", lost))


def merged_in_order(manifest: DataFrame, proposals: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """position, case_id, proposed_id, m, p: both tables row by row in their own orders. What one side lacks is null there.
    Places come from range partitions, so no task sees a whole table; the tables meet by place."""
    side = lambda df, order, name, id_: positioned(df, order).select("position", F.col("case_id").alias(id_), F.struct(*df.columns).alias(name))
    return side(manifest, order_a, "m", "case_id").join(side(proposals, order_b, "p", "proposed_id"), "position", "full_outer")


def ground_truth(manifest: DataFrame, proposals: DataFrame, order_a: list[str], order_b: list[str], stamp: dict[str, str]) -> DataFrame:
    """Manifest rows with the labels of the proposals in the same places. Another case in a place, a review that breaks a
    constraint, or one that a person must decide fails the job. ``stamp`` is written to every row."""
    met = merged_in_order(manifest, proposals, order_a, order_b)
    flat = met.select("position", "case_id", "proposed_id", F.col("m"), "p.*", F.col("m.record_type").alias("_type")) if "record_type" not in proposals.columns else met.select("position", "case_id", "proposed_id", F.col("m"), "p.*")
    flat = flat.drop("case_id").withColumn("case_id", F.col("m.case_id")).withColumn("record_type", F.col("m.record_type"))
    rows = checked(flat, structured_constraints())
    wrong = (
        F.when(~F.col("case_id").eqNullSafe(F.col("proposed_id")), "order").when(F.size("faults") > 0, "review").when(F.col("requires_human"), "undecided")
    )
    fine = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(" at "), F.col("position").cast("string"))).cast("string")).otherwise(F.col("case_id"))
    kept = [c for c in manifest.columns if c not in ("case_id", "context", "text")]
    return rows.select("position", fine.alias("case_id"), *(F.col(f"m.{c}").alias(c) for c in kept), "truth", "structural_region", "expected_diagnostics", "rationale", *(F.lit(v).alias(k) for k, v in stamp.items()))
