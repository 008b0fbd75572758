"""Common parts of the SQL that the registered queries are held against."""

from __future__ import annotations

from ..functions.chars import SPACE_RE2, TOKEN_RE2

Q = lambda s: s.replace("'", "''")
SENTENCES = rf"""
    cut AS (SELECT doc_id, text, unnest(l) AS piece, generate_subscripts(l, 1) AS k
            FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+') AS l FROM documents)),
    placed AS (SELECT doc_id, text, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(piece) AS off,
                      regexp_replace(piece, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g') AS s,
                      length(piece) - length(regexp_replace(piece, '^[{SPACE_RE2}]+', '')) AS lead FROM cut),
    sentences AS (SELECT doc_id, text, k - 1 AS ordinal, (off + lead)::BIGINT AS "start", (off + lead + length(s))::BIGINT AS "end", s,
                         regexp_matches(s, '[.!?]$') AS complete FROM placed WHERE length(s) > 0)"""
SIMPLE = rf"""CASE WHEN NOT regexp_matches(s, '[^\p{{L}}{SPACE_RE2},.!?:;]') THEN len(regexp_extract_all(s, '\p{{L}}+')) END"""
TOKENS = rf"""
    cut AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS k
            FROM (SELECT doc_id, regexp_extract_all(text, '{Q(TOKEN_RE2)}') AS l FROM documents))"""


def place(text: str, at: str) -> str:
    """line and column of an offset."""
    return f"""(length(left({text}, ({at})::INT)) - length(replace(left({text}, ({at})::INT), chr(10), '')) + 1)::BIGINT AS line,
               (length(split_part(left({text}, ({at})::INT), chr(10), -1)) + 1)::BIGINT AS "column" """


def long_sentences(limit: int) -> str:
    return f"""WITH {SENTENCES}, counted AS (SELECT *, {SIMPLE} AS words FROM sentences WHERE complete)
        SELECT doc_id, "start", "end", words::BIGINT AS words, {place("text", '"start"')} FROM counted WHERE words > {limit}"""


SPANS = f"""{SENTENCES}, spans AS (SELECT * FROM (SELECT *, {SIMPLE} AS words FROM sentences WHERE complete) WHERE words > 20)"""
PRINTS = rf"""
    {SPANS},
    named AS (SELECT doc_id, "start", "end", 'algorithm=1' || chr(10) || 'rule_id=SENT-001' || chr(10) || 'uri=' || doc_id || '.txt' || chr(10) || 'span='
              || trim(regexp_replace(s, '[{SPACE_RE2}]+', ' ', 'g')) || chr(10) || 'context='
              || trim(regexp_replace(split_part(left(text, "start"::INT), chr(10), -1) || s || split_part(substr(text, "end"::INT + 1), chr(10), 1), '[{SPACE_RE2}]+', ' ', 'g')) AS identity FROM spans),
    prints AS (SELECT doc_id, "start", "end", 'sha256:' || sha256(identity || chr(10) || 'ordinal=' ||
               (row_number() OVER (PARTITION BY identity ORDER BY doc_id || '.txt', "start", "end") - 1)) AS fingerprint FROM named)"""
UNITS = """
    hits AS (SELECT DISTINCT doc_id FROM spans),
    units AS (SELECT d.doc_id, d.source, d.lang, l.toxic, l.quality,
                     CASE WHEN l.doc_id IS NULL THEN 'ambiguous' WHEN l.quality = 0 THEN 'out_of_scope' WHEN l.toxic = 1 THEN 'violation' ELSE 'non_violation' END AS label,
                     h.doc_id IS NOT NULL AS emitted
              FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN hits h ON h.doc_id = d.doc_id)"""
STRICT = """count(*) FILTER (label = 'violation' AND emitted) AS tp,
    count(*) FILTER (label IN ('non_violation', 'out_of_scope') AND emitted) AS fp,
    count(*) FILTER (label = 'violation' AND NOT emitted) AS fn, count(*) FILTER (label = 'non_violation' AND NOT emitted) AS tn"""
CONSERVATIVE = """count(*) FILTER (label = 'violation' AND emitted) AS tp,
    count(*) FILTER (label IN ('non_violation', 'out_of_scope', 'ambiguous') AND emitted) AS fp,
    count(*) FILTER (label IN ('violation', 'ambiguous') AND NOT emitted) AS fn, count(*) FILTER (label = 'non_violation' AND NOT emitted) AS tn"""
HOLDOUT = STRICT.replace("label = 'non_violation' AND NOT", "label IN ('non_violation', 'out_of_scope') AND NOT")


def wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054::DOUBLE"
    mid = f"(({k})::DOUBLE / ({n}) + {z} * {z} / (2 * ({n})))"
    half = f"({z} * sqrt((({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) + {z} * {z} / (4 * ({n}))) / ({n})))"
    scale = f"(1 + {z} * {z} / ({n}))"
    return tuple(f"CASE WHEN ({n}) > 0 THEN round(({mid} {sign} {half}) / {scale}, 9) END" for sign in "-+")
