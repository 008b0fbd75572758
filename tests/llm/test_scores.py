"""Token alignment, ranked search and toxicity against brute force, and in the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import alignment, queries, search, toxicity

from .test_operators import DOCS, docs, none, prose, rows, words  # noqa: F401

PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [" two  spaces ", "▁x", "a ▁ b", "<s> <|endoftext|> </s>", "tab\there \n new \r\n line", "é è́ 日本 　x", "\x00\x01 a", "x   y z ", "don't we'll 12 345,6!!"]


@pytest.fixture(scope="module")
def mixed(spark, rows):  # noqa: F811
    """The shared rows and texts of odd characters."""
    out = rows + [(900 + i, t, "en", "s0", "x", 1) for i, t in enumerate(ODD)]
    return out, spark.createDataFrame(out, DOCS).repartition(3)


def brute_alignment(texts):
    """The contract, over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path(PATHS[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(PATHS[1]))
    of, name = alignment.byte_of(), {i: t for t, i in a.get_vocab().items()}
    out, counts = [], Counter()
    for k, text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        of_a = [bytes(of[c] for c in name[i]) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or {b"".join(of_a), b"".join(of_b)} != {(" " + text).encode()}:
            out.append((k, 0, 0, [], ""))
            continue
        ends = [{int(e): i for i, e in enumerate(np.cumsum([len(w) for w in own]))} for own in (of_a, of_b)]
        groups, links, at = [], [], (0, 0)
        for e in sorted(ends[0].keys() & ends[1].keys()):
            to = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids_a[at[0] : to[0]])) + "|" + ",".join(map(str, ids_b[at[1] : to[1]])))
            links.append((ids_a[to[0] - 1], ids_b[to[1] - 1]))
            at = to
        counts.update(links)
        out.append((k, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(k, m, n, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), d) for k, m, n, x, d in out]


NULLS_LAST = lambda r: tuple((v is None, v) for v in r)


@pytest.mark.parametrize("small", [{}, {"stripes": 7, "block_chars": 9000, "slot_links": 1500}])
def test_alignment_is_brute_force(mixed, small):
    pytest.importorskip("public_tokenizers")
    own, df = mixed
    got = alignment.aligned(df, *map(queries.tokenizer_path, PATHS), **small).collect()
    assert sorted(map(tuple, got), key=NULLS_LAST) == sorted(brute_alignment([(r[0], r[1]) for r in own]), key=NULLS_LAST)
    odd = {r.id: r for r in got}
    assert odd[901].n_a == 0 and odd[901].groups_sha256 == "" and odd[903].n_links > 3 and odd[900].n_links > 0


def test_alignment_of_nothing(none):  # noqa: F811
    pytest.importorskip("public_tokenizers")
    assert alignment.aligned(none, *map(queries.tokenizer_path, PATHS)).collect() == []


def test_units_are_whole_texts(words):  # noqa: F811
    """Ids by unit against ids of the whole text, with a cache that overflows."""
    pytest.importorskip("public_tokenizers")
    p = alignment.Pair(*map(queries.tokenizer_path, PATHS))
    rng = random.Random(3)
    texts = ["".join(rng.choice([*words, " ", "  ", "\n", "\t ", "!!", "1 2", " ", "é", "\x1c ", "'s "]) for _ in range(60)) for _ in range(150)]
    for text in texts:
        units = p.units(text)
        assert " ".join(units) == text
        assert [i for u in units for i in p.a.encode(" " + u, add_special_tokens=False).ids] == p.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in units for i in p.b.encode(u)] == p.b.encode(text)
    alignment.MOST_UNITS, before = 50, alignment.MOST_UNITS
    try:
        first = alignment.block_rows(p, texts[:9])[0]["groups_sha256"]
        for t in texts:
            alignment.block_rows(p, [t])
        assert alignment.block_rows(p, texts[:9])[0]["groups_sha256"] == first
    finally:
        alignment.MOST_UNITS = before


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute_search(texts, items, top=10):
    own = [(k, Counter(terms(t))) for k, t in texts]
    n_docs, n_words = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for k, t in items:
        asked[k] |= set(terms(t))
    out = []
    for item, ws in asked.items():
        found = []
        for k, c in own:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * (10 + (90 * n * n_docs) // n_words))) for w in ws if w in c)
            if score > 0:
                found.append((score, k))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r + 1, k, s) for r, (s, k) in enumerate(found[:top])]
    return out


@pytest.fixture(scope="module")
def items(spark, words):  # noqa: F811
    own = [(k, prose(words, 12, 500 + k)) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "The THE the, 日本"), (7, "one don't"), (None, "changed1 one"), (34, "x" * 70_000 + " 345")]
    return own, spark.createDataFrame([(i, t, 5) for i, t in own], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("small", [{}, {"block_terms": 60, "block_docs": 7}])
def test_search_is_brute_force(mixed, items, small):
    own, df = mixed
    asked, frame = items
    got = [tuple(r) for r in search.search(df, frame, **small).collect()]
    want = brute_search([(r[0], r[1]) for r in own], asked)
    assert sorted(got, key=NULLS_LAST) == sorted(want, key=NULLS_LAST)
    assert {r[0] for r in got} >= {33, 34, None} and not {30, 31, 32} & {r[0] for r in got}


def test_search_of_nothing(docs, none, items, spark):  # noqa: F811
    assert search.search(none, items[1]).collect() == []
    assert search.search(docs, items[1].limit(0)).collect() == []


def test_accumulation_by_slices(monkeypatch):
    """Any slicing and any number of items gives the sums of a plain dictionary."""
    rng = np.random.default_rng(4)
    start = np.concatenate([[0], np.cumsum(rng.integers(0, 5, 40))])
    own = rng.integers(0, 70_000, start[-1]).astype(np.uint32)
    doc = np.sort(rng.integers(0, 30, 300))
    term, impact = rng.integers(0, 40, 300), rng.integers(0, 1 << 40, 300)
    want = Counter()
    for t, d, i in zip(term.tolist(), doc.tolist(), impact.tolist()):
        for item in own[start[t] : start[t + 1]].tolist():
            want[item, d] += i
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(search, "MOST_TRIPLES", most)
        got = Counter()
        for item, d, s in search.accumulate(term, doc, impact, start, own, 70_000):
            for k, v in zip(zip(item.tolist(), d.tolist()), s.tolist()):
                assert k not in got
                got[k] = v
        assert got == want


def test_long_texts_are_sliced_between_terms():
    text = " ".join(f"w{k}" for k in range(400_000)) + " " + "é" * 1_200_000 + " End"
    assert [w.decode() for s in search.term_slices(text) for w in s] == terms(text)


def test_search_matches_its_sql(spark, mixed, items, tmp_path):
    import duckdb

    mixed[1].select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = db.sql(queries.ORACLES["op12_lexical_search"]).fetchall()
    got = [tuple(r) for r in queries.op12_lexical_search(spark, str(tmp_path)).collect()]
    assert sorted(got, key=NULLS_LAST) == sorted(want, key=NULLS_LAST)


BAD = ["grubbel", "snarfig", "wretchbo", "foulmank"]


@pytest.fixture(scope="module")
def labelled(spark, words):  # noqa: F811
    """Prose of which a quarter holds forms of bad words; a bad stem in clean text once in a while."""
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(900):
        w = prose(words, 40 + rng.randint(0, 120), 9000 + k).split(" ")
        toxic = k % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(words)
        texts.append((k, " ".join(w), k % 3))
        if k % 10 < 8:
            labels.append((k, int(toxic), 1 - int(toxic)))
    texts += [(2000, None, 1), (2001, "", 1), (None, "grubbelan snarfigre", 1), texts[0], (2002, "ok " * 400_000 + " grubbelan snarfigre foulmankti wretchboon", 1)]
    labels += [(None, 1, 0), (0, None, 0), (1, 7, 0), (4, 0, 1)]  # a null id, no label, no such label, two labels
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(3)
    return texts, labels, frame, spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity_on_the_held_out_fold(labelled):
    texts, labels, df, frame = labelled
    got = toxicity.scored(df, frame).collect()
    assert len(got) == len(texts) and all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    unseen = [r for r in got if r.id is not None and r.id < 900 and (r.held_out or r.id % 10 >= 8)]
    caught = [r.predicted for r in unseen if r.id % 4 == 0]
    assert sum(caught) >= 0.95 * len(caught) and sum(r.predicted for r in unseen if r.id % 4) <= 0.01 * len(unseen)
    one = {r.id: r for r in got}
    assert one[2002].predicted == 1 and one[None].predicted == 1 and one[2000].score == one[2001].score < 0.7
    assert len({r.score for r in got if r.id == 0}) == 1


def test_labels_of_the_held_out_fold_and_other_columns_tell_nothing(spark, labelled):
    texts, labels, df, frame = labelled
    held = {k for k, *_ in texts if k is not None and zlib.crc32(str(k).encode()) % 3 == 1}
    turned = spark.createDataFrame([(k, None if v is None else 1 - v if k in held else v, x) for k, v, x in labels], frame.schema)
    first, second = (sorted(toxicity.scored(df, f).collect(), key=lambda r: (r.id is None, r.id)) for f in (frame, turned))
    assert [(r.id, r.predicted) for r in first] == [(r.id, r.predicted) for r in second]
    assert np.allclose([r.score for r in first], [r.score for r in second], atol=1e-6)


def test_toxicity_without_labels_or_rows(labelled, none):  # noqa: F811
    _, _, df, frame = labelled
    assert {r.score for r in toxicity.scored(df, frame.limit(0)).collect()} == {1 / (1 + math.exp(60))}
    assert toxicity.scored(none, frame).collect() == []


def test_ngrams_stay_within_words():
    """Buckets are those of a plain listing, whatever the slices."""
    text = "The  idiot, été 12\n" * 3
    want = Counter()
    for w in re.findall(r"[a-z0-9é]+", text.lower()):
        w = f" {w} "
        want.update(w[i : i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1))
    got = Counter(b for part in toxicity.buckets(text) for b in part.tolist())
    assert sorted(got.values()) == sorted(want.values())


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(1)
    starts = np.arange(0, 3 * 400 + 1, 3)
    rows, values = rng.integers(0, 20, 1200), rng.random(1200) + 0.5
    y = np.array([rows[3 * k : 3 * k + 3].min() < 4 for k in range(400)])
    scale = rng.random(20) + 0.5
    w = toxicity.logistic(rows, values, starts, y, 20, scale, 1e-2, 200)

    def loss(w):
        z = np.array([(w[rows[a : a + 3]] * scale[rows[a : a + 3]] * values[a : a + 3]).sum() for a in starts[:-1]]) + w[-1]
        return np.logaddexp(0, np.where(y, -z, z)).mean() + 5e-3 * (w[:-1] @ w[:-1])

    assert all(loss(w) <= loss(w + d) + 1e-6 for d in 0.05 * rng.normal(size=(50, 21)))


def test_encoders_and_sorts_agree(words):  # noqa: F811
    """The quick encoder and the tokenizer itself, many units at once and one by one, packed keys and sorts by parts."""
    pytest.importorskip("public_tokenizers")
    p, q = (alignment.Pair(*map(queries.tokenizer_path, PATHS)) for _ in range(2))
    assert p.quick is not None
    texts = [prose(words, 80, k) for k in range(20)] + ODD
    first = alignment.block_rows(p, texts)
    q.quick, alignment.JOINED, before = None, 5, alignment.JOINED
    try:
        second = alignment.block_rows(q, texts)
    finally:
        alignment.JOINED = before
    assert first[0]["groups_sha256"] == second[0]["groups_sha256"] and (first[1] == second[1]).all() and (first[2] == second[2]).all()
    _, links, docs = first  # noqa: F811
    packed = alignment.by_stripe(links, docs, 7, (p.n_b, p.n_a), len(texts))
    parts = alignment.by_stripe(links, docs, 7, (p.n_b, 1 << 40), len(texts))
    assert all((x == y).all() for x, y in zip(packed, parts))
    assert Counter(zip(packed[0].tolist(), packed[1].tolist())) == Counter(zip(links.tolist(), docs.tolist()))
    b = (packed[0] >> np.uint64(32)) % np.uint64(7)
    assert all((b[packed[2][s] : packed[2][s + 1]] == s).all() for s in range(7)) and packed[2][-1] == len(links)
