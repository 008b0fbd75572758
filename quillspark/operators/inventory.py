"""Inventories of review units: records, their order, caps, contracts, totals and digests."""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plain import places, walked, walked_units

PENDING = "pending-review"
CONTEXTS = ("visible_prose", "markup_or_code", "uncertain")
RECORD = ("case_id", "rule_id", "source_id", "uri", "text_type", "start", "end", "start_line", "start_column", "end_line", "end_column", "unit_kind", "structural_context", "slice_sha256", "truth", "review_status")


def held(df: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint, so that two readings of it see the same rows in the same places."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()


def rank_of(value: Column, order: Iterable[str]) -> Column:
    """The place of a value in a fixed order; a value that is not in it fails the job."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no rank: "), F.coalesce(value, F.lit("null")))).cast("int"))


def order_keys(sources: Iterable[str], rules: Iterable[str], kinds: Iterable[str]) -> list[Column]:
    """The seven keys of an inventory: source, document, start, end, rule, kind, case. Sources, rules and kinds are in the
    orders given, the others ascend."""
    return [rank_of(F.col("source_id"), sources), F.col("uri"), F.col("start"), F.col("end"), rank_of(F.col("rule_id"), rules), rank_of(F.col("unit_kind"), kinds), F.col("case_id")]


def case_id(prefix: str = "unit-") -> Column:
    parts = (F.col(c).cast("string") for c in ("rule_id", "source_id", "uri", "start", "end", "unit_kind"))
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *parts), 256))


def records(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Units (uri, source_id, text_type, rule_id, unit_kind, start, end, structural_context) as records: coordinates of both
    ends, a digest of the slice, a case id from the content, and the state before review. Units of a document meet its text
    once, which is walked once."""
    units = units.select("uri", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), *NAMES)
    return stated(walked_units(units, docs, PLACED, placed))


def found_records(docs: DataFrame, find: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """Records as of ``records``, of the units that ``find`` yields of a document (a dict of its columns, text among them): found and
    placed in one walk, nothing is shuffled."""
    return stated(walked(docs, PLACED, lambda doc: placed(doc["text"], list(find(doc)))))


NAMES = ("source_id", "text_type", "rule_id", "unit_kind", "structural_context")
PLACED = "start int, end int, " + ", ".join(f"{n} string" for n in NAMES) + ", start_line int, start_column int, end_line int, end_column int, slice_sha256 string"


def placed(text: str | None, own: list[dict]) -> Iterator[tuple]:
    """Units of one text with the places of both ends and a digest of the slice."""
    at = places(text or "", {u[k] for u in own for k in ("start", "end")})
    for u in own:
        cut = (text or "")[max(u["start"], 0) : u["end"]]
        yield u["start"], u["end"], *(u[n] for n in NAMES), *at.get(u["start"], (None, None)), *at.get(u["end"], (None, None)), hashlib.sha256(cut.encode()).hexdigest()


def stated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"case_id": case_id(), "truth": F.lit(PENDING), "review_status": F.lit(PENDING)}).select(*RECORD)


def made_records(uri: str, text: str, units: Iterable[dict]) -> Iterator[dict]:
    """Units of one document as records, as ``found_records`` has them."""
    columns = [c.split()[0] for c in PLACED.split(", ")]
    for row in placed(text, list(units)):
        r = dict(zip(columns, row), uri=uri, truth=PENDING, review_status=PENDING)
        parts = (r["rule_id"], r["source_id"], uri, str(r["start"]), str(r["end"]), r["unit_kind"])
        r["case_id"] = "unit-" + hashlib.sha256("\0".join(x for x in parts if x is not None).encode()).hexdigest()
        yield r


UNIT = ("rule_id", "source_id", "start", "end", "unit_kind")
SIDES = ("start_line", "start_column", "end_line", "end_column")
MOST_SHARED = 100_000  # case ids that are sent to all tasks


def contract_faults(rows: DataFrame, docs: DataFrame, rules: Iterable[str], excluded: dict[str, list[str]] | None = None) -> DataFrame:
    """Records that break their contract (uri, case_id, start, end, faults), with all codes: unknown_rule, context, state, case_id,
    excluded (a document that its rule leaves out), duplicate (all records of a repeated unit or id), document, span, slice,
    start_place, end_place. Repeats inside a document and the last five come from a walk over each text that has records; only ids are
    compared between documents."""
    ends = (F.col(c).cast("int").alias(c) for c in ("start", "end"))
    asked = rows.select("uri", *ends, "case_id", "slice_sha256", *SIDES, "rule_id", "source_id", "unit_kind", own_codes(rules, excluded).alias("own"))

    def each(text: str | None, units: list[dict]) -> Iterator[tuple]:
        for u, (twice, codes) in zip(units, text_codes(text, units)):
            yield u["case_id"], u["start"], u["end"], u["own"], twice, codes

    checked = walked_units(asked, docs, "case_id string, start int, end int, own string, twice boolean, codes string", each)
    return told_faults(checked, rows.select("uri", "case_id").distinct())


def found_faults(docs: DataFrame, find: Callable[[dict], Iterable[dict]], rules: Iterable[str], excluded: dict[str, list[str]] | None = None) -> DataFrame:
    """``contract_faults`` of the records that ``find`` yields of a document (a dict of its columns, uri and text among them; ``uri`` is
    unique): found and checked in one walk. Only the ids are shuffled, and ``find`` runs twice over each document."""
    own = (*UNIT, "case_id", "structural_context", "truth", "review_status")

    def each(doc: dict) -> Iterator[tuple]:
        units = list(find(doc))
        for u, more in zip(map(itemgetter(*own), units), text_codes(doc["text"] or "", units)):
            yield *u, *more

    schema = ", ".join(f"{c} {'int' if c in ('start', 'end') else 'string'}" for c in own)
    checked = walked(docs, f"{schema}, twice boolean, codes string", each).withColumn("own", own_codes(rules, excluded))
    return told_faults(checked, walked(docs, "case_id string", lambda doc: ((c,) for c in {u["case_id"] for u in find(doc)})))


def own_codes(rules: Iterable[str], excluded: dict[str, list[str]] | None = None) -> Column:
    """The codes that a record's own columns tell, joined by commas."""
    left_out = F.lit(False)
    for rule, uris in (excluded or {}).items():
        left_out = left_out | ((F.col("rule_id") == rule) & F.col("uri").isin(*uris))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    codes = {
        "unknown_rule": no(F.col("rule_id").isin(*rules)), "context": no(F.col("structural_context").isin(*CONTEXTS)), "state": no((F.col("truth") == PENDING) & (F.col("review_status") == PENDING)),
        "case_id": no(F.col("case_id") == case_id()), "excluded": left_out,
    }
    return F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items()))), ",")


def text_codes(text: str | None, units: list[dict]) -> Iterator[tuple[bool, str]]:
    """Whether each record of one document is there twice, as a unit or by its id, and the codes that the text tells."""
    at = places(text or "", {u[k] for u in units for k in ("start", "end") if u[k] is not None})
    unit = itemgetter(*UNIT)
    same, ids = Counter(map(unit, units)), Counter(u["case_id"] for u in units)
    for u in units:
        faults, a, b = [], u["start"], u["end"]
        if text is None:
            faults.append("document")
        elif a is None or b is None or not 0 <= a < b <= len(text):
            faults.append("span")
        else:
            if hashlib.sha256(text[a:b].encode()).hexdigest() != u["slice_sha256"]:
                faults.append("slice")
            if at[a] != (u["start_line"], u["start_column"]):
                faults.append("start_place")
            if at[b] != (u["end_line"], u["end_column"]):
                faults.append("end_place")
        yield same[unit(u)] > 1 or ids[u["case_id"]] > 1, ",".join(faults)


def told_faults(checked: DataFrame, ids: DataFrame) -> DataFrame:
    """Checked records (case_id, own, twice, codes) that have a fault. ids: the distinct case ids of each document; those of several
    documents, of which a sound inventory has none, are held and met with the records."""
    shared = held(ids.groupBy("case_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("case_id").alias("_id"), F.lit(True).alias("_far")))
    met = checked.join(F.broadcast(shared) if shared.count() <= MOST_SHARED else shared, checked["case_id"].eqNullSafe(shared["_id"]), "left")
    again = F.when(F.col("twice") | F.col("_far").isNotNull(), "duplicate")
    faults = F.filter(F.split(F.concat_ws(",", "own", again, "codes"), ","), lambda x: x != "")
    return met.select("uri", "case_id", "start", "end", faults.alias("faults")).filter(F.size("faults") > 0)


def order_faults(rows: DataFrame, keys: list[Column], part: str, place: str) -> DataFrame:
    """Rows that are less than the one before them. Rows lie in parts (files, say) one after another, each with its own
    places: the last row of a part is compared with the first of the next that has rows. A range sort by part and place deals
    the rows out; neighbours are compared inside a range, and the last row of a range with the first of the next."""
    ranged = held(rows.withColumn("_key", F.struct(*keys)).repartitionByRange(part, place).withColumn("_range", F.spark_partition_id()))
    inside = ranged.withColumn("_before", F.lag("_key").over(Window.partitionBy("_range").orderBy(part, place)))
    ends = ranged.groupBy("_range").agg(F.max_by("_key", F.struct(part, place)).alias("_last"))  # a row a range
    border = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_border"))
    both = inside.join(F.broadcast(border), "_range").withColumn("_before", F.coalesce("_before", "_border"))
    return both.filter(F.col("_before") > F.col("_key")).drop("_key", "_before", "_border", "_range")


def digests(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, n, digest: equal for equal bags of rows, however they are ordered and dealt. Four sums of 60-bit pieces of each
    row's SHA-256 are digested; sums do not depend on order and are formed map-side."""
    by = by or []
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select(*by, line.alias("_h"))
    pieces = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashed.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(p).alias(f"_s{i}") for i, p in enumerate(pieces)))
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"_s{i}").cast("string") for i in range(4))), 256).alias("digest"))


def differing(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose rows are not the same in two builds."""
    a, b = (digests(x, by).select(*by, F.col("digest").alias(n)) for x, n in ((one, "_a"), (other, "_b")))
    return a.join(b, by, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by)


def positioned(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Rows with their place from 1 in a global order, without a window over all: a range sort deals them out, is held, and
    the rows of the ranges before are added to the place within the range."""
    ranged = held(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.join(F.broadcast(sizes.withColumn("_before", before)), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_part", "_id", "_n", "_first", "_before")


def capped(units: DataFrame, caps: dict[str, int], order: list[Column | str], salts: int = 64) -> DataFrame:
    """Units of each rule up to its cap, the first in order (a sample by digest, say). Rules without a cap, or with no more units
    than it allows, keep all. Of others, ranks are taken in ``salts`` parts of a rule first and then, by a range sort, among what
    those keep, so that neither a rule with most of the rows nor a large cap is a single task's work."""
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col("rule_id")].cast("long")
    counts = units.groupBy("rule_id").agg(F.count("*").alias("_n")).withColumn("_cap", cap)  # a row a rule
    told = counts.select("rule_id", F.when(F.col("_n") > F.col("_cap"), F.col("_cap")).alias("_cap"))
    met = units.join(F.broadcast(told), units["rule_id"].eqNullSafe(told["rule_id"])).drop(told["rule_id"])
    first = Window.partitionBy("rule_id", "_salt").orderBy(*order)
    salted = met.filter("_cap > 0").withColumn("_salt", F.pmod(F.xxhash64(*units.columns), F.lit(salts)))
    kept = positioned(salted.withColumn("_rank", F.row_number().over(first)).filter("_rank <= _cap"), ["rule_id", *order], "_place")
    begins = kept.groupBy("rule_id").agg(F.min("_place").alias("_begin"))
    last = kept.join(F.broadcast(begins), "rule_id").filter("_place - _begin < _cap")
    return last.select(*units.columns).unionByName(met.filter("_cap is null").select(*units.columns))


#: Which count of a document goes into which rule's total, and for which text type (null: all).
TOTALS = (("SENT-001", "sentences", "procedural"), ("SENT-002", "sentences", "descriptive"), ("PARA-001", "paragraphs", "descriptive"), ("SEMI-001", "semicolons", None), ("LIST-001", "list_runs", None))


def rule_totals(counts: DataFrame, caps: dict[str, int], excluded: dict[str, list[str]] | None = None) -> DataFrame:
    """rule_id, units, cap, status (OK, EXCEEDED, or null without a cap) of counts by document (uri, text_type, sentences, paragraphs,
    semicolons, list_runs). ``excluded`` names documents that a rule leaves out. One pass over the counts."""
    sums = []
    for rule, column, text_type in TOTALS:
        where = F.lit(True) if text_type is None else F.col("text_type") == text_type
        if uris := (excluded or {}).get(rule):
            where = where & ~F.col("uri").isin(*uris)
        sums.append(F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0)).cast("long").alias(rule))
    rows = counts.agg(*sums).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.col(f"`{r}`").alias("units"), F.lit(caps.get(r)).cast("long").alias("cap")) for r, _, _ in TOTALS))))
    return rows.withColumn("status", F.when(F.col("units") <= F.col("cap"), "OK").when(F.col("cap").isNotNull(), "EXCEEDED"))


def text_type_conflicts(documents: DataFrame) -> DataFrame:
    """rule_id, documents, conflicting (documents of several text types) of unit rows (rule_id, uri, text_type)."""
    per = documents.groupBy("rule_id", "uri").agg(F.count_distinct("text_type").alias("types"))
    return per.groupBy("rule_id").agg(F.count("*").alias("documents"), F.count_if(F.col("types") > 1).alias("conflicting"))
