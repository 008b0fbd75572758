"""A projection of Markdown that keeps every length: markup becomes blanks, and lines whose markup is in doubt are marked.

What a line is depends on paired marks before it (front matter, fences, comments), so a document is walked once, in batches of
whole texts, and comes out as line rows. A pair that is never closed puts all lines from there on in doubt; in a line, an odd
number of backtick runs or unequal shortcode braces do. Blocks, list runs with their lead-ins and counts are windows over the
line rows; texts are not shuffled.

Lines end at LF or CRLF. A null text has no lines. A text with other line separators has one line row of kind "separator", with
all of it in doubt and nothing projected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import SPACE
from .plain import walked

# What a line or a part of it is.
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
LINE_KINDS = (
    ("heading", re.compile(r" {0,3}#{1,6}(?:\s|$)")),
    ("thematic_break", re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")),
    ("reference_definition", re.compile(r" {0,3}\[[^]]+\]:")),
    ("shortcode", re.compile(r"\s*\{\{[<%].*[>%]\}\}\s*$")),
    ("html_block", re.compile(r"\s*</?[A-Za-z][^>]*>\s*$")),
    ("indented_code", re.compile(r" {4}|\t")),
)
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)\s*$")
TABLE_RULE = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")
ITEM = re.compile(r"( *)([-+*]|\d+[.)])\s+(?=.*$)")
QUOTE = re.compile(r" {0,3}>\s?")
WHOLE = tuple(map(re.compile, (r"!\[[^]]*\]\([^)]*\)", r"`+[^`]*`+", r"<(?:https?|mailto):[^>]+>", r"\{\{[<%].*?[>%]\}\}", r"</?[A-Za-z][^>]*>", r"&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);")))
LABELLED = tuple(map(re.compile, (r"\[([^]]+)]\([^)]*\)", r"\[([^]]+)]\[[^]]*]")))
SEPARATOR = re.compile("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|\r(?!\n)")
TICKS = re.compile("`+")
#: What a line has at its start if it is of one of the kinds, and what it has if any of its marks goes: other lines are not looked at closer.
STRUCTURAL, MARKED = re.compile(r"\s*[#*\-_\[{<]| {4}|\t"), re.compile(r"[`\[<{}&]")
#: What stands between a list and its lead-in, in the order in which it is listed.
BLOCKERS = ("heading", "fence", "thematic_break", "blockquote", "more_than_one_blank_line")

LINE = "uri string, k int, start int, end int, kind string, uncertain boolean, marker int, family string, quote boolean, empty boolean, indent int, shown string, run_end int, peers int"
KINDS = dict(uri=pa.string(), k=pa.int32(), start=pa.int32(), end=pa.int32(), kind=pa.string(), uncertain=pa.bool_(), marker=pa.int32(), family=pa.string(), quote=pa.bool_(), empty=pa.bool_(), indent=pa.int32(), shown=pa.string(), run_end=pa.int32(), peers=pa.int32())


def line_kinds(lines: list[str]) -> tuple[list[str], int]:
    """The kind of each line ("visible" if it is not structural), and the line from which on all is in doubt."""
    n, k = len(lines), 0
    kinds, doubt = ["visible"] * n, n
    fences = [m[1] if (m := FENCE.match(x)) else "" for x in lines]
    longest = {c: [0] * (n + 1) for c in "`~"}  # of the fences from a line on
    for i in range(n - 1, -1, -1) if any(fences) else ():
        for c, most in longest.items():
            most[i] = max(most[i + 1], len(fences[i]) if fences[i][:1] == c else 0)
    last_close = max((i for i, x in enumerate(lines) if "-->" in x), default=-1)
    if n and lines[0] == "---":
        close = next((i for i in range(1, n) if lines[i] in ("---", "...")), None)
        if close is None:
            doubt = 0
        else:
            kinds[: close + 1], k = ["front_matter"] * (close + 1), close + 1
    while k < n:
        mark, close = fences[k], None
        if mark:
            if longest[mark[0]][k + 1] >= len(mark):
                close = next(i for i in range(k + 1, n) if fences[i][:1] == mark[0] and len(fences[i]) >= len(mark))
        elif "<!--" in lines[k]:
            if "-->" in lines[k].split("<!--", 1)[1]:
                close = k
            elif last_close > k:
                close = next(i for i in range(k + 1, n) if "-->" in lines[i])
        else:
            if k < doubt and STRUCTURAL.match(lines[k]):
                kinds[k] = next((name for name, kind in LINE_KINDS if kind.match(lines[k])), "visible")
            k += 1
            continue
        if close is None:
            doubt, close = min(doubt, k), k
        else:
            kinds[k : close + 1] = ["fence" if mark else "html_comment"] * (close + 1 - k)
        k = close + 1
    for i in range(1, min(n, doubt)):
        if kinds[i] == "visible" and UNDERLINE.match(lines[i]) and lines[i - 1].strip():
            kinds[i - 1] = kinds[i] = "heading"
        if kinds[i] == "visible" and TABLE_RULE.match(lines[i]):
            rows = next((j for j in range(i + 1, n) if "|" not in lines[j]), n)
            kinds[i - 1 : rows] = ["table"] * (rows - i + 1)
    return kinds, doubt


def shown_line(line: str) -> tuple[str, bool]:
    """A line with its markup blanked, and whether that is in doubt."""
    if not MARKED.search(line):
        n = m.end() if (m := ITEM.match(line) or QUOTE.match(line)) else 0
        return " " * n + line[n:], False
    gone = [m.span() for kind in WHOLE for m in kind.finditer(line)]
    for kind in LABELLED:
        for m in kind.finditer(line):
            gone += [(m.start(), m.start(1)), (m.end(1), m.end())]
    if m := ITEM.match(line) or QUOTE.match(line):
        gone.append((0, m.end()))
    chars = list(line)
    for a, b in gone:
        chars[a:b] = " " * (b - a)
    return "".join(chars), len(TICKS.findall(line)) % 2 == 1 or line.count("{{") != line.count("}}")


def projected_lines(text: str, hanging: bool = True) -> list[dict]:
    """Line rows of a text. An item that begins a list run of two items or more tells the run's end and its items. Prose that is
    indented deeper than an item goes on with it; with ``hanging`` false, any prose ends the runs before it."""
    if SEPARATOR.search(text):
        return [dict(k=0, start=0, end=len(text), kind="separator", uncertain=True, quote=False, empty=False, indent=0, shown=text)]
    raw = text.split("\n")
    if not raw[-1]:
        raw.pop()
    lines = [x.removesuffix("\r") if k < len(raw) - 1 or text.endswith("\n") else x for k, x in enumerate(raw)]
    kinds, doubt = line_kinds(lines)
    out: list[dict] = []
    open_runs: list[tuple[int, str, dict, list[int]]] = []  # indentation, family, first item, [items], by indentation
    at = reach = 0

    def close(beyond: int, family: str = "") -> None:
        """Ends the runs that are indented deeper, and those as deep that are of another family."""
        while open_runs and (open_runs[-1][0] > beyond or (family and open_runs[-1][0] == beyond and open_runs[-1][1] != family)):
            _, _, first, items = open_runs.pop()
            if items[0] > 1:
                first.update(run_end=reach, peers=items[0])

    for k, (whole, line, kind) in enumerate(zip(raw, lines, kinds)):
        row = dict(k=k, start=at, end=at + len(line), kind=kind, uncertain=k >= doubt, quote=bool(QUOTE.match(line)), empty=not line.strip(), indent=len(line) - len(line.lstrip(" ")), shown=" " * len(line))
        at += len(whole) + 1
        out.append(row)
        if kind == "visible":
            row["shown"], odd = shown_line(line)
            row["uncertain"] |= odd
        if kind != "visible" or row["quote"]:
            close(-1)
        elif row["empty"]:
            row["kind"] = "blank"
        elif m := ITEM.match(line):
            depth, family = len(m[1]), "ordered" if m[2][0].isdigit() else "bullet"
            row.update(marker=depth, family=family)
            close(depth, family)
            if open_runs and open_runs[-1][0] == depth:
                open_runs[-1][3][0] += 1
            else:
                open_runs.append((depth, family, row, [1]))
            reach = row["end"]
        else:
            close(row["indent"] - 1 if hanging else -1)
            reach = row["end"]
    close(-1)
    return out


def lines(docs: DataFrame, hanging: bool = True) -> DataFrame:
    """The line rows of documents (uri, text)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text")):
                rows += (dict(x, uri=uri) for x in projected_lines(text.as_py(), hanging))
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], kind) for c, kind in KINDS.items()], names=list(KINDS))

    return docs.select("uri", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(walk, LINE)


def blocks(ls: DataFrame, with_body: bool = False, hanging: bool = True) -> DataFrame:
    """uri, first_line, last_line, kind (prose, list or quote), start, end, uncertain, shown_start, shown_end, terminal: what
    is left visible by the projection, from and to its first and last character, and the last one.

    A structural or blank line ends a block, an item begins one, quoted lines are one. Behind an item, deeper lines are its
    own until one is not; that one begins prose, as the first does with ``hanging`` false. ``with_body`` adds the visible text, lines trimmed and joined by blanks.
    """
    by = Window.partitionBy("uri").orderBy("k")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = F.when((F.col("kind") != "visible"), "gap").when(F.col("marker").isNotNull(), "list").when(F.col("quote"), "quote").otherwise("prose")
    ls = ls.withColumn("side", side).withColumn("segment", F.sum((side != "prose").cast("int")).over(so_far))
    # a segment is a line that is no prose and the prose behind it
    own = Window.partitionBy("uri", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = F.first("marker").over(own)
    free = F.coalesce(F.col("indent") <= under, F.lit(True)) if hanging else F.lit(True)
    left = F.max(((F.col("side") == "prose") & free).cast("int")).over(own)
    ls = ls.withColumn("left", left)
    begins = (F.col("side") == "list") | ((F.col("side") == "quote") & (F.coalesce(F.lag("side").over(by), F.lit("")) != "quote")) | ((F.col("side") == "prose") & (F.col("left") == 1) & (F.coalesce(F.lag("left").over(Window.partitionBy("uri", "segment").orderBy("k")), F.lit(0)) == 0))
    ls = ls.withColumn("block", F.sum(begins.cast("int")).over(so_far)).filter("side <> 'gap'")
    shown = F.regexp_replace("shown", rf"[{SPACE}]+$", "")
    lead = F.length("shown") - F.length(F.regexp_replace("shown", rf"^[{SPACE}]+", ""))
    seen = F.length(shown) > 0
    trimmed = F.regexp_replace(shown, rf"^[{SPACE}]+", "")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", trimmed.alias("t")))), lambda x: x["t"]), " ")
    found = ls.groupBy("uri", "block").agg(
        *([body.alias("body")] if with_body else []),
        F.min("k").alias("first_line"), F.max("k").alias("last_line"), F.min_by("side", "k").alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("uncertain").alias("uncertain"),
        F.min(F.when(seen, F.col("start") + lead)).alias("shown_start"), F.max(F.when(seen, F.col("start") + F.length(shown))).alias("shown_end"),
        F.max_by(F.right(shown, F.lit(1)), F.when(seen, F.col("k"))).alias("terminal"), F.bool_or(F.rlike("shown", F.lit(r"[\p{L}\p{N}_]"))).alias("words"),
    )
    return found.filter("words").drop("words", "block")


def list_units(ls: DataFrame, hanging: bool = True) -> DataFrame:
    """List runs with what leads them in: uri, start, end, family, indentation, peers, uncertain, lead_in_status (found,
    uncertain or not_found), lead_in_start, lead_in_end, blank_lines (-1 without a lead-in), list_terminal (period, colon, other
    or absent), blockers.

    The lead-in is the last block that ends before the run: an as-of join of runs and blocks by line. What lies between is told
    by running counts, as they stand at the run less as they stood at the end of the block.
    """
    by = Window.partitionBy("uri").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {"blank": F.col("empty"), "doubtful": F.col("uncertain"), "quoted": F.col("quote")} | {k: F.col("kind") == k for k in ("heading", "fence", "thematic_break")}
    counts = F.struct(*(F.sum(c.cast("int")).over(by).alias(n) for n, c in kinds.items()))
    counted = ls.withColumn("counts", counts)
    ends = blocks(ls, hanging=hanging).select("uri", F.col("last_line").alias("k"), F.struct("uncertain", "shown_start", "shown_end", "terminal").alias("b"))
    both = counted.join(ends, ["uri", "k"], "left").withColumn("b", F.when(F.col("b").isNotNull(), F.struct("b.*", F.col("counts").alias("then"))))
    before = Window.partitionBy("uri").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("lead", F.last("b", ignorenulls=True).over(before)).withColumn("now", F.lag("counts").over(Window.partitionBy("uri").orderBy("k")))
    marked = found.withColumn("marks", F.struct(F.col("uncertain").cast("int").alias("own"), F.col("counts.doubtful").alias("total")))
    runs = marked.filter("peers is not null")
    between = lambda n: F.col(f"now.{n}") - F.col(f"lead.then.{n}")
    none = F.col("lead").isNull()
    blockers = F.array(*(F.when(between(n) > 0, k) for n, k in zip(("heading", "fence", "thematic_break", "quoted"), BLOCKERS)), F.when(between("blank") > 1, BLOCKERS[4]))
    terminal = F.when(none, "absent").when(F.col("lead.terminal") == ".", "period").when(F.col("lead.terminal") == ":", "colon").otherwise("other")
    status = F.when(none, "not_found").when(F.col("lead.uncertain") | (between("doubtful") > 0), "uncertain").otherwise("found")
    # a run is in doubt if one of its lines is
    last = counted.select("uri", F.col("end").alias("run_end"), F.col("counts.doubtful").alias("at_end"))
    runs = runs.join(last, ["uri", "run_end"])
    return runs.select(
        "uri", "start", F.col("run_end").alias("end"), "family", F.col("marker").alias("indentation"), "peers", (F.col("at_end") - F.col("marks.total") + F.col("marks.own") > 0).alias("uncertain"),
        status.alias("lead_in_status"), F.coalesce("lead.shown_start", F.lit(-1)).alias("lead_in_start"), F.coalesce("lead.shown_end", F.lit(-1)).alias("lead_in_end"),
        F.when(none, -1).otherwise(between("blank")).alias("blank_lines"), terminal.alias("list_terminal"), F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(blockers)).alias("blockers"),
    )


UNITS = "start int, end int, family string, indentation int, peers int, uncertain boolean, lead_in_status string, lead_in_start int, lead_in_end int, blank_lines int, list_terminal string, blockers string, lead_in string"
COUNTED = {"blank": lambda x: x["empty"], "doubtful": lambda x: x["uncertain"], "quoted": lambda x: x["quote"]} | {k: lambda x, k=k: x["kind"] == k for k in ("heading", "fence", "thematic_break")}
WORD = re.compile(r"\w")


def found_list_units(docs: DataFrame, hanging: bool = True) -> DataFrame:
    """The list runs of documents (uri, text) as of ``list_units``, with the text of the lead-in (empty without one): lines, blocks and
    runs of a text are found in one walk, no line goes on and nothing is shuffled."""
    found = walked(docs.select("uri", F.coalesce("text", F.lit("")).alias("text")), UNITS, lambda doc: text_units(doc["text"], hanging))
    return found.withColumn("blockers", F.filter(F.split("blockers", ","), lambda x: x != ""))


def text_blocks(rows: list[dict], hanging: bool = True) -> list[dict]:
    """The blocks of one text's line rows as ``blocks`` has them, with their bodies."""
    out: list[dict] = []
    before, under, left = "gap", None, False  # the side of the line before, the item's depth that prose goes on with, and whether it did not
    for x in rows:
        side = "gap" if x["kind"] != "visible" else "list" if x.get("marker") is not None else "quote" if x["quote"] else "prose"
        if side == "prose":
            free = not hanging or under is None or x["indent"] <= under
            begins, left = free and not left, free or left
        else:
            begins, left, under = side == "list" or (side == "quote" and before != "quote"), False, x.get("marker")
        before = side
        if side == "gap":
            continue
        if begins:
            out.append(dict(first_line=x["k"], kind=side, start=x["start"], uncertain=False, shown_start=None, shown_end=None, terminal=None, words=False, body=[]))
        block, body = out[-1], x["shown"].strip()
        block.update(last_line=x["k"], end=x["end"], uncertain=block["uncertain"] or x["uncertain"], words=block["words"] or WORD.search(body) is not None)
        block["body"].append(body)
        if body:
            at = x["start"] + len(x["shown"]) - len(x["shown"].lstrip())
            block.update(shown_start=at if block["shown_start"] is None else block["shown_start"], shown_end=at + len(body), terminal=body[-1])
    return [b for b in out if b["words"]]


def text_units(text: str, hanging: bool = True) -> Iterator[tuple]:
    """The list runs of one text."""
    rows = projected_lines(text, hanging)
    runs = [x for x in rows if x.get("peers")]
    if not runs:
        return
    led = text_blocks(rows, hanging)
    counts = {n: [0, *accumulate(map(told, rows))] for n, told in COUNTED.items()}  # of the lines before each
    line = {x["end"]: x["k"] for x in rows}
    near = -1
    for x in runs:
        k = x["k"]
        while near + 1 < len(led) and led[near + 1]["last_line"] < k:
            near += 1
        # a run is in doubt if one of its lines is
        doubt = counts["doubtful"][line[x["run_end"]] + 1] > counts["doubtful"][k]
        unit = (x["start"], x["run_end"], x["family"], x["marker"], x["peers"], doubt)
        if near < 0:
            yield *unit, "not_found", -1, -1, -1, "absent", "", ""
            continue
        lead = led[near]
        between = {n: c[k] - c[lead["last_line"] + 1] for n, c in counts.items()}
        apart = [name for n, name in zip(("heading", "fence", "thematic_break", "quoted"), BLOCKERS) if between[n]] + [BLOCKERS[4]] * (between["blank"] > 1)
        status = "uncertain" if lead["uncertain"] or between["doubtful"] else "found"
        terminal = {".": "period", ":": "colon"}.get(lead["terminal"], "other")
        yield *unit, status, lead["shown_start"], lead["shown_end"], between["blank"], terminal, ",".join(apart), text[lead["shown_start"] : lead["shown_end"]]


#: A stop that ends a sentence: marks that close and white space, or nothing, are behind it. Fixed value.
TERMINAL = re.compile(r"[.!?](?=[\"'’”)\]]*(?:[ \t\n\x0b\f\r]|$))")


def scan_counts(docs: DataFrame, hanging: bool = True) -> DataFrame:
    """uri, complete, incomplete, paragraphs, semicolons, list_runs of every document: whole sentences and unfinished rests of its
    blocks, blocks of prose, semicolons of the text, list runs. No line or unit rows are made, and nothing is shuffled."""

    def each(doc: dict) -> Iterator[tuple]:
        rows = projected_lines(doc["text"], hanging)
        found = text_blocks(rows, hanging)
        complete = incomplete = 0
        for body in (" ".join(b["body"]) for b in found):
            stops = [m.end() for m in TERMINAL.finditer(body)]
            complete += len(stops)
            incomplete += WORD.search(body, stops[-1] if stops else 0) is not None
        yield complete, incomplete, sum(b["kind"] == "prose" for b in found), doc["text"].count(";"), sum("peers" in x for x in rows)

    return walked(docs.select("uri", F.coalesce("text", F.lit("")).alias("text")), ", ".join(f"{c} long" for c in ("complete", "incomplete", "paragraphs", "semicolons", "list_runs")), each)


def summary(ls: DataFrame) -> DataFrame:
    """Characters, blanked characters and lines in doubt of each document."""
    shown = F.length(F.regexp_replace("shown", rf"[{SPACE}]", ""))
    return ls.groupBy("uri").agg(F.sum(F.length("shown")).alias("chars"), F.sum(shown).alias("visible"), F.count("*").alias("lines"), F.count_if("uncertain").alias("uncertain_lines"), F.count_if(~F.col("kind").isin("visible", "blank")).alias("structural_lines"))
