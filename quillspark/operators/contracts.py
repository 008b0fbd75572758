"""Contracts of records that come from elsewhere: shapes of candidate analyses, invariants of parses, review packets, run records."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plain import places, walked, walked_units

# Fields of a candidate analysis and of its parts.
RECORD = ("abstention_reason", "case_id", "document_id", "schema_version", "sentences", "surface_tokens", "text", "words")
TOKEN = ("end", "start", "text")
WORD = ("dependency", "features", "form", "head_word_index", "lemma", "sentence_index", "surface_token_index", "upos", "xpos")
SENTENCE = ("end", "first_surface_token", "first_word", "past_last_surface_token", "past_last_word", "start")
BLIND = ("case_id", "document_id", "text", "abstention_reason")
SEMICOLON, CONTROL = "literal_semicolon", "zero_semicolon_control"


def fields_of(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of all fields, those in structs, arrays and maps too."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in (f"{path}{f.name}", *fields_of(f.dataType, f"{path}{f.name}."))]
    if isinstance(schema, T.ArrayType):
        return fields_of(schema.elementType, path)
    return fields_of(schema.valueType, path) if isinstance(schema, T.MapType) else []


def without(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """The frame, if no field of it, however deep, has a forbidden name; the schema tells, no row is read."""
    found = sorted(p for p in fields_of(df.schema) if p.rsplit(".", 1)[-1].lower() in {f.lower() for f in forbidden})
    if found:
        raise ValueError(f"forbidden fields: {', '.join(found)}")
    return df


def kind_of(value: Column) -> Column:
    """The type of a variant: STRING, BIGINT, BOOLEAN, VOID, or one that begins with OBJECT or ARRAY; null where it is missing."""
    kind = F.schema_of_variant(value)
    return F.when(F.rlike(kind, F.lit(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$")), "BIGINT").otherwise(kind)


def candidate_faults(records: DataFrame, column: str = "json") -> DataFrame:
    """``records`` with ``faults``: not_json, fields, scalars, collections, token_fields, word_fields, features, sentence_fields,
    abstention. Fields must be exactly those of the contract, and a boolean is no integer. The texts are parsed once."""
    v = F.try_parse_json(F.col(column))
    parsed = records.withColumn("_v", v)
    value = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    keys = lambda x: F.sort_array(F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>")))
    exact = lambda x, names: keys(x) == F.array(*map(F.lit, names))
    is_ = lambda x, *kinds: F.coalesce(kind_of(x).isin(*kinds), F.lit(False))
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    listed = lambda name: F.coalesce(F.try_variant_get("_v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    all_of = lambda conditions: reduce(lambda a, b: a & b, conditions)
    an_array = lambda x: F.coalesce(F.startswith(kind_of(x), F.lit("ARRAY")), F.lit(False))

    def token(t: Column) -> Column:
        return exact(t, TOKEN) & is_(field(t, "text"), "STRING") & is_(field(t, "start"), "BIGINT") & is_(field(t, "end"), "BIGINT")

    def word(w: Column) -> Column:
        strings = (is_(field(w, n), "STRING", "VOID") for n in ("lemma", "upos", "xpos", "dependency"))
        return exact(w, WORD) & is_(field(w, "form"), "STRING") & is_(field(w, "surface_token_index"), "BIGINT") & is_(field(w, "sentence_index"), "BIGINT") & is_(field(w, "head_word_index"), "BIGINT", "VOID") & all_of(strings)

    def features(w: Column) -> Column:
        pairs = F.try_variant_get(w, "$.features", "array<variant>")
        pair = lambda p: F.coalesce(F.size(F.try_variant_get(p, "$", "array<variant>")) == 2, F.lit(False)) & is_(F.try_variant_get(p, "$[0]", "variant"), "STRING") & is_(F.try_variant_get(p, "$[1]", "variant"), "STRING")
        return is_(field(w, "features"), "VOID") | F.coalesce(F.forall(pairs, pair), F.lit(False))

    def sentence(s: Column) -> Column:
        return exact(s, SENTENCE) & all_of(is_(field(s, n), "BIGINT") for n in SENTENCE)

    an_object = F.coalesce(F.startswith(kind_of(F.col("_v")), F.lit("OBJECT")), F.lit(False))
    codes = {
        "not_json": ~an_object, "fields": an_object & ~exact(F.col("_v"), RECORD), "scalars": an_object & ~(is_(value("case_id"), "STRING") & is_(value("text"), "STRING")),
        "collections": an_object & ~all_of(an_array(value(n)) for n in ("surface_tokens", "words", "sentences")), "token_fields": ~F.forall(listed("surface_tokens"), token),
        "word_fields": ~F.forall(listed("words"), word), "features": F.exists(listed("words"), lambda w: ~features(w)), "sentence_fields": ~F.forall(listed("sentences"), sentence),
        "abstention": an_object & ~is_(value("abstention_reason"), "STRING", "VOID"),
    }
    return parsed.withColumn("faults", F.array_compact(F.array(*(F.when(c, k) for k, c in codes.items())))).drop("_v")


def blind_inputs(gold: DataFrame) -> DataFrame:
    """What a model may see of gold records; those without an id or a text, or with an empty reason, fail the job."""
    fine = F.col("case_id").isNotNull() & (F.col("case_id") != "") & F.col("text").isNotNull() & ~F.coalesce(F.col("abstention_reason") == "", F.lit(False))
    case = F.when(fine, F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("not an input: "), F.coalesce("case_id", F.lit("null")))).cast("string"))
    return gold.select(case.alias("case_id"), *BLIND[1:])


def analysed(inputs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Inputs with their analyses (case_id, surface_tokens, words, sentences). A case that abstains has empty ones, whatever was
    supplied; one that is neither analysed nor abstains fails the job."""
    parts = ("surface_tokens", "words", "sentences")
    met = inputs.join(analyses.withColumn("_there", F.lit(True)), "case_id", "left")
    quiet = F.col("abstention_reason").isNotNull()
    lost = F.raise_error(F.concat(F.lit("no analysis: "), F.col("case_id"))).cast("string")
    case = F.when(quiet | F.col("_there").isNotNull(), F.col("case_id")).otherwise(lost)
    return met.select(case.alias("case_id"), *BLIND[1:], *(F.when(quiet, F.array().cast(analyses.schema[p].dataType)).otherwise(F.col(p)).alias(p) for p in parts))


def harness_records(cases: DataFrame, tokens: DataFrame, sentences: DataFrame, words: DataFrame, reasons: DataFrame) -> DataFrame:
    """Offset cases (``offsets``: uri, text; tokens; sentences with their word ranges; words; abstention reasons) as one nested
    record a case, words with the number of their sentence. Lists are of one case, whose size bounds them."""
    numbered = sentences.withColumn("s", F.row_number().over(Window.partitionBy("uri").orderBy("first_token")) - 1)
    home = words.alias("w").join(numbered.alias("n"), F.expr("w.uri = n.uri and w.token >= n.first_token and w.token < n.past_last_token"), "left")
    lists = {
        "surface_tokens": tokens.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("token", "text", "start", "end"))).alias("surface_tokens")),
        "words": home.groupBy("w.uri").agg(F.sort_array(F.collect_list(F.struct("w.word", "w.form", "w.token", "n.s"))).alias("words")),
        "sentences": numbered.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("s", "start", "end", "first_token", "past_last_token", "first_word", "past_last_word"))).alias("sentences")),
    }
    met = cases.select("uri", "text").join(reasons, "uri", "left")
    for name, part in lists.items():
        met = met.join(part, "uri", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return met.select(
        F.col("uri").alias("case_id"), "text", F.transform("surface_tokens", lambda t: F.struct(t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"))).alias("surface_tokens"),
        F.transform("words", lambda w: F.struct(w["form"].alias("form"), w["token"].alias("surface_token_index"), w["s"].alias("sentence_index"))).alias("words"),
        F.transform("sentences", lambda s: s.dropFields("s")).alias("sentences"), "abstention_reason",
    )


def analysis_faults(texts: DataFrame, tokens: DataFrame, sentences: DataFrame, words: DataFrame) -> DataFrame:
    """uri, fault, n of parses that break an invariant. texts: uri, text. tokens: uri, token, start, end, text. sentences: uri, sentence,
    start, end, first_token, past_last_token, first_word, past_last_word. words: uri, word, sentence, token, head (null: root).

    token_order, token_slice, sentence_partition (ranges leave a gap, overlap or miss the end), sentence_span, word_sentence,
    word_token, head_outside, roots (not exactly one), and coverage (tokens without sentences or words, or the other way round). A document's rows meet its text once, and are
    walked once; columns must be integers as ``walked`` has them."""
    listed = lambda df, name: df.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != "uri")))).alias(name))
    parts = [
        listed(tokens.select("uri", "token", "start", "end", F.col("text").alias("shown")), "tokens"), listed(words.select("uri", "word", "sentence", "token", "head"), "words"),
        listed(sentences.select("uri", "sentence", "start", "end", "first_token", "past_last_token", "first_word", "past_last_word"), "sentences"),
    ]
    met = reduce(lambda x, y: x.join(y, "uri", "full_outer"), parts).join(texts.select("uri", "text"), "uri", "left")
    return walked(met, "fault string, n int", lambda doc: iter(Counter(invariant_faults(doc["text"], doc["tokens"] or [], doc["sentences"] or [], doc["words"] or [])).items()))


def parsed_faults(docs: DataFrame, analyse: Callable[[dict], tuple[str, list[dict], list[dict], list[dict]]]) -> DataFrame:
    """uri, fault, n as of ``analysis_faults``, where a parser runs over the documents: ``analyse`` returns the text, tokens, sentences
    and words of one. They are checked where they lie, and no token or word is shuffled."""
    return walked(docs, "fault string, n int", lambda doc: iter(Counter(invariant_faults(*analyse(doc))).items()))


def invariant_faults(text: str | None, tokens: list[dict], sentences: list[dict], words: list[dict]) -> Iterator[str]:
    """The faults of one document's parse, each as often as it is there."""
    end, by_number = 0, {}
    for t in tokens:
        by_number[t["token"]] = t
        if t["start"] < end or t["start"] >= t["end"]:
            yield "token_order"
        if text is None or text[max(t["start"], 0) : t["end"]] != t["shown"]:
            yield "token_slice"
        end = t["end"]
    if bool(tokens) != bool(sentences) or bool(tokens) != bool(words):
        yield "coverage"
    homes, roots, next_token, next_word = {s["sentence"]: s for s in sentences}, Counter(), 0, 0
    for w in words:
        s = homes.get(w["sentence"])
        inside = lambda n, first, last: s is not None and s[first] <= n < s[last]  # noqa: B023, E731
        if not inside(w["word"], "first_word", "past_last_word"):
            yield "word_sentence"
        if not inside(w["token"], "first_token", "past_last_token"):
            yield "word_token"
        if w["head"] is None:
            roots[w["sentence"]] += 1
        elif not inside(w["head"], "first_word", "past_last_word"):
            yield "head_outside"
    for s in sentences:
        if (s["first_token"], s["first_word"]) != (next_token, next_word):
            yield "sentence_partition"
        next_token, next_word = s["past_last_token"], s["past_last_word"]
        first, last = by_number.get(s["first_token"]), by_number.get(s["past_last_token"] - 1)
        if first is None or last is None or (first["start"], last["end"]) != (s["start"], s["end"]):
            yield "sentence_span"
        if roots[s["sentence"]] != 1:
            yield "roots"
    if sentences and (next_token, next_word) != (len(tokens), len(words)):
        yield "sentence_partition"


def packet_faults(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, faults of a review packet's manifest (case_id, record_type, uri, file_sha256, offset, byte_offset, column) against the
    documents: no_document, file_digest, record_type, not_a_semicolon, byte_offset, column, control_has_semicolon, duplicate. The rows of
    a document meet its text once, and it is walked once."""
    twice = manifest.withColumn("twice", F.count("*").over(Window.partitionBy("case_id")) > 1)
    asked = twice.select("uri", F.col("offset").cast("int").alias("offset"), "case_id", "record_type", "file_sha256", F.col("byte_offset").cast("long").alias("byte_offset"), F.col("column").cast("int").alias("at"), "twice")

    def each(text: str | None, rows: list[dict]) -> Iterator[tuple]:
        body = text or ""
        digest, at = hashlib.sha256(body.encode()).hexdigest(), places(body, {r["offset"] for r in rows if r["offset"] is not None})
        seen = before = 0
        for r in rows:  # by offset, those without one first
            faults, o = [], r["offset"]
            kind = r["record_type"]
            if text is None:
                faults.append("no_document")
            elif digest != r["file_sha256"]:
                faults.append("file_digest")
            if kind not in (SEMICOLON, CONTROL):
                faults.append("record_type")
            elif text is not None and kind == SEMICOLON:
                inside = o is not None and 0 <= o < len(body)
                if inside:
                    before, seen = before + len(body[seen:o].encode()), o
                checks = (("not_a_semicolon", inside and body[o] == ";"), ("byte_offset", inside and before == r["byte_offset"]), ("column", inside and at[o][1] == r["at"]))
                faults += [name for name, fine in checks if not fine]
            elif text is not None and ";" in body:
                faults.append("control_has_semicolon")
            if r["twice"]:
                faults.append("duplicate")
            if faults:
                yield r["case_id"], ",".join(faults)

    found = walked_units(asked, docs, "case_id string, faults string", each)
    return found.select("case_id", F.split("faults", ",").alias("faults"))


def count_faults(counted: DataFrame, expected: dict[str, int]) -> DataFrame:
    """field, expected, got of a one-row frame of counts that are not those registered before."""
    rows = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("got")) for k, v in expected.items()))
    return counted.select(F.inline(rows)).filter(~F.col("expected").eqNullSafe(F.col("got")))


def lint_invoked(stdout: Column, stderr: Column, command: str = "quillspark") -> Column:
    """Whether a run's logs show that the linter ran: its command, a summary that only tells its exit, or its event."""
    log = F.concat_ws("\n", F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))
    event = F.rlike(log, F.lit(r'"exit_code"\s*:\s*0')) & F.contains(log, F.lit(command.upper()))
    return F.rlike(log, F.lit(rf"{command}\s+lint")) | F.rlike(log, F.lit(r"(?i)\blint\s+exit\s*0\b")) | event


def run_artifacts(paths: DataFrame) -> DataFrame:
    """model, condition, run, case_id, path of the first Markdown file (by name) of each run: .../model/condition/run/file.md. The case
    is the number at the start of the run's name, or else the name."""
    part = lambda n: F.element_at(F.split("path", "/"), -n)
    files = paths.filter(F.col("path").endswith(".md") & (F.size(F.split("path", "/")) >= 4)).select(part(4).alias("model"), part(3).alias("condition"), part(2).alias("run"), "path")
    first = files.groupBy("model", "condition", "run").agg(F.min("path").alias("path"))
    case = F.regexp_extract("run", r"^(case-\d+)", 1)
    return first.withColumn("case_id", F.when(case != "", case).otherwise(F.col("run")))


def without_text(analyses: DataFrame, columns: tuple[str, ...] = ("text", "form", "lemma")) -> DataFrame:
    """uri, json: analyses as canonical JSON that holds no words of the text: such fields go, however deep."""

    def kept(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(kept(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in columns))
        return F.transform(c, lambda x: kept(x, kind.elementType)) if isinstance(kind, T.ArrayType) else c

    fields = [f for f in analyses.schema.fields if f.name not in columns]
    return analyses.select("uri", F.to_json(F.struct(*(kept(F.col(f.name), f.dataType).alias(f.name) for f in sorted(fields, key=lambda f: f.name))), {"ignoreNullFields": "false"}).alias("json"))
