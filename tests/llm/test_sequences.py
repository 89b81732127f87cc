"""Fill-in-middle, byte-level tokens and periodic runs against plain versions."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from postlake.llm import byte_bpe, fim, runs
from postlake.llm.queries import QUERIES, byte_ranks
from pyspark.sql import functions as F

SF = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
LONG = " ".join(f"word{i % 977} is here\nand" for i in range(20_000))
ROWS = [(1, None), (2, ""), (None, "a\nb\nc"), (3, LONG), (3, LONG), (4, "x " * 50_000), (5, "\n\n\n"), (6, "<S> x\ny"), (7, "ä\nöü\n€"), (8, "z" * 30_000)]


def sha(value) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in ("n", "form", "output", "ids", "n_tokens", "runs", "start", "n_runs", "decoded")})


# ---- fill-in-middle


def cut_plainly(doc_id, text, seed=7):
    units = [u + "\n" for u in (text or "").split("\n")[:-1]] + [u for u in [(text or "").split("\n")[-1]] if u]
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text or ""
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(edge):
    got = fim.transform(edge).collect()
    assert sorted([(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=str) == sorted([cut_plainly(d, t) for d, t in ROWS], key=str)
    back = fim.restored(fim.transform(edge)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(d, t or "") for d, t in ROWS], key=str)
    done = fim.digests(edge).collect()
    assert sorted(r.restored_sha256 for r in done) == sorted(sha(t or "") for _, t in ROWS)
    assert fim.digests(edge.limit(0)).collect() == []


@pytest.mark.parametrize("error", [0, 3, 8191, 40_000])
def test_rank_index(error):
    rng = np.random.default_rng(error)
    for n in (1, 2, 3, 70, 5_000):
        for gaps in (rng.integers(0, 300, n), np.ones(n, int), rng.geometric(0.001, n), (rng.random(n) < 0.01) * 50_000):
            offsets = np.cumsum(gaps)
            index = fim.fit(offsets, error)
            assert (index.locate(np.arange(n)) == offsets).all()
            assert np.abs(index.residual).max() <= error + 1
    assert len(fim.fit(np.arange(100_000) * 60, 8).first) == 1


def test_marks_are_told_apart():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>"), ("<a", "a>", "<M>")):
        with pytest.raises(ValueError):
            fim.Settings(prefix=bad[0], suffix=bad[1], middle=bad[2]).marks()
    for form in ("psm", "spm"):
        for parts in ((b"<P", b"<S", b"M>"), (b"<", b"<", b"<"), (b"", b"", b"")):
            assert fim.restore(fim.rearrange(form, parts, fim.Settings().marks()), form) == b"".join(parts)


def test_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\n").alias("text"))
    forms = [r.form for r in fim.transform(df, settings=fim.Settings(fim=50, spm=10)).collect()]
    assert 150 < forms.count("plain") < 250 and 5 < forms.count("spm") < 50


# ---- byte-level tokens


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = byte_ranks()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.load(*byte_ranks()))


def ids_of(encoder, texts):
    return [[int(x) for x in a.split()] for a, _ in encoder.encode(texts)]


def test_byte_tokens(spark, edge, texts, library):
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        want = library.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(want), sha(" ".join(map(str, want))))
        assert got[d].decoded_sha256 == sha(t or "")
    path, pattern = byte_ranks()
    coded = byte_bpe.encode(edge, path, pattern)
    back = byte_bpe.decode(coded, path).collect()
    assert sorted([(r.doc_id, bytes(r.decoded)) for r in back], key=str) == sorted([(d, (t or "").encode()) for d, t in ROWS], key=str)
    assert {r.doc_id: r.ids for r in coded.collect()}[4] == library.encode_ordinary("x " * 50_000)
    assert byte_bpe.digests(edge, path, pattern).count() == len(ROWS) and byte_bpe.encode(edge.limit(0), path, pattern).collect() == []


def test_every_sort_of_character(encoder, library):
    """Both Unicode tables: characters beside another sort, and those of another sort in either table."""
    import regex

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    sort = [regex.sub(r"\p{L}", "x", regex.sub(r"\p{N}", "0", regex.sub(r"\s", " ", c))) for c in every]
    sort = [s if s in "x0 " else "!" for s in sort]
    some = [c for i, c in enumerate(every) if sort[i] != sort[max(i - 1, 0)] or sort[i] != sort[min(i + 1, len(sort) - 1)]]
    some += map(chr, encoder.model.unlike)
    assert len(some) > 1_500
    lines = ["".join(f"a{c}1{c} {c}!" for c in some[k:k + 500]) for k in range(0, len(some), 500)]
    assert ids_of(encoder, lines) == library.encode_ordinary_batch(lines)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aab bcst'\n\r\t 19.!?äß€日本🙂՘​\x1c\x85"), max_size=60), max_size=5))
def test_any_text(encoder, library, some):
    assert ids_of(encoder, some) == [library.encode_ordinary(t) for t in some]


def test_long_pieces(encoder, library):
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdeéü") for _ in range(20_000)), "a" * 30_000, " " * 5_000 + "x", "=-" * 4_000]
    assert ids_of(encoder, some) == [library.encode_ordinary(t) for t in some]
    assert [b for _, b in encoder.encode(some)] == [t.encode() for t in some]


def test_perfect_hash():
    for n in (1, 2, 5, 1_000, 20_000):
        keys = [b"k%d" % (i * i) for i in range(n)]
        assert sorted(byte_bpe.perfect_hash(keys).slots(keys).tolist()) == list(range(n))


def test_whole_tokens_are_resolved_by_the_hash(encoder):
    tokens = [t for t in encoder.model.tokens if t]
    assert encoder.known(tokens) == [i for i, t in enumerate(encoder.model.tokens) if t]
    assert encoder.known([b"surely no token of any vocabulary"]) == [-1]


# ---- periodic runs


def plain_runs(w, least=12):
    """All maximal stretches by definition: period by period, smallest period first."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def run_list(told, least=12):
    number = {}
    flat = np.array([number.setdefault(x, len(number)) for ws in told for x in ws], np.int64)
    first = np.cumsum([0, *map(len, told)])
    r = runs.find(flat, first, least)
    out = [[] for _ in told]
    for d, s, e, q in zip(r.doc.tolist(), r.start.tolist(), r.end.tolist(), r.period.tolist()):
        out[d].append((s - int(first[d]), e - s, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.sampled_from("ab"), max_size=90),
    st.builds(lambda r, k, t: (r * k)[:200] + t, st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(1, 20), st.lists(st.sampled_from("abc"), max_size=9)),
), max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_of_any_words(told, least):
    assert run_list(told, least) == [plain_runs(w, least) for w in told]


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_hard_words():
    rng = random.Random(5)
    root = [rng.choice("abcd") for _ in range(150)]
    told = [fibonacci(900), ["a"] * 700, root * 5, (["a"] * 90 + ["b"]) * 8, (["a", "b"] * 30 + ["a"]) * 7, (root + root[:70]) * 3]
    assert run_list(told) == [plain_runs(w) for w in told]


def test_pairs_in_pieces(monkeypatch):
    told = [fibonacci(400), ["a"] * 300, (["a"] * 40 + ["b"]) * 6]
    monkeypatch.setattr(runs, "PAIRS", 50)
    assert run_list(told) == [plain_runs(w) for w in told]


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (
        len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
        sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_periodic_runs(spark, edge, texts):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    small = {d: t for d, t in texts.items() if len((t or "").split()) < 1_500}
    assert got.keys() == texts.keys() and len(small) > 100
    assert {d: got[d] for d in small} == {d: expected(d, t) for d, t in small.items()}
    rows = {r.doc_id: r for r in runs.collapse(edge).collect()}
    assert [tuple(r) for r in rows[4].runs] == [(0, 50_000, 1)] and rows[4].collapsed == "x"
    assert len(rows[3].runs) == 1 and rows[3].runs[0].period == 977 * 4
    assert rows[1].runs == [] and rows[1].collapsed == "" and rows[None].collapsed == "a b c"
    assert runs.digests(edge).count() == len(ROWS) and runs.collapse(edge.limit(0)).collect() == []


def test_long_runs_take_no_square_of_pairs():
    n = 200_000
    assert run_list([["a"] * n])[0] == [(0, n, 1)]
