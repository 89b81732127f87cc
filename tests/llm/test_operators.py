"""Each operator against a brute-force version on the smallest tables."""

from __future__ import annotations

import datetime
import hashlib
import html as html_module
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import bpe, decontaminate, html, jaccard, neighbours, pii, secrets, suffix
from postlake.llm.arrow import slices
from postlake.llm.queries import ORACLES, PII_KEY, QUERIES, tokenizer_path

SF = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(value: bytes | str) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def repeated_spans(texts: dict[int, bytes]) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(texts[d][i:i + 50], d)
    out = {}
    for d, b in texts.items():
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                change[i] += 1
                change[i + 50] -= 1
        gone = np.cumsum(change)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""))
    return out


@pytest.mark.parametrize("bucket_bytes", [suffix.BUCKET_BYTES, 50_000])
def test_suffix_dedup(spark, texts, monkeypatch, bucket_bytes):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket_bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert got == repeated_spans({d: (t or "").encode() for d, t in texts.items()})


def test_partly_equal_phrases(spark):
    """Passages in different surroundings go through the suffix array."""
    passage = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(3, "aaaa " + passage + " one"), (1, "other start " + passage), (2, "x" + passage[:60] + "!"), (4, passage[5:60])]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()}
    assert got == repeated_spans({d: t.encode() for d, t in rows})


def test_few_rows_between_the_steps(spark, texts):
    """A task sends a row per bucket or group of buckets, not one for each of its slices."""
    some = " ".join(t for t in texts.values() if t)[:200_000]
    docs = spark.createDataFrame([(i, f"{i} {some}") for i in range(50)], "_id long, _text string").coalesce(1)
    buckets = 600
    assert 0 < suffix._triggers(docs, buckets).count() <= buckets / 4


@pytest.mark.parametrize("pack_bytes", [1 << 14, 1 << 17])
def test_suffix_dedup_in_packs_and_groups(spark, monkeypatch, pack_bytes):
    """Many small slices, packs and buckets, four buckets a row; rows without an id and of one id in between."""
    for name, value in (("BUCKET_BYTES", 200), ("PACK_BYTES", pack_bytes), ("PARSE_BYTES", 2_000), ("BLOCK", 8)):
        monkeypatch.setattr(suffix, name, value)
    monkeypatch.setattr(suffix, "slices", lambda batch, column, limit=8_000: slices(batch, column, limit))
    words = [f"w{i * i % 7919}" for i in range(4_000)]
    rows = [(1_000 - i, " ".join(words[i * 53 % 3_000:][:20 + i % 60]) + f" end{i % 7}") for i in range(400)]
    assert suffix._together(sum(len(t) for _, t in rows) // 200) == 4
    odd = [(None, rows[3][1]), (None, None), (5_000, None), (5_001, ""), (5_002, words[0])]
    twice = [(6_000, "only in rows of one id, " * 4), (6_000, "only in rows of one id, " * 4)]
    docs = spark.createDataFrame([*rows[:200], *odd, *twice, *rows[200:]], "doc_id long, text string").coalesce(3)
    got = suffix.dedup(docs).collect()
    want = repeated_spans({d: (t or "").encode() for d, t in [*rows, *odd[2:]]})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id in want} == want
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got if r.doc_id not in want) == [
        (0, 0, 0), (0, len(rows[3][1].encode()), 0), (6_000, 96, 0), (6_000, 96, 0)]


def links(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {d: frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else []) for d, w in ((d, words(t)) for d, t in texts.items())}
    near = {d: [e for e in sets if e != d and sets[d] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])] for d in sets}
    out = {}
    for d in sorted(sets):
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()]:
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        out[d] = (min(seen), len(near[d]))
    return out


@pytest.mark.parametrize("small", [jaccard.SMALL, 3])
def test_ngram_join(spark, texts, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    some = " ".join(f"w{i}" for i in range(120))
    more = {10_000 + i: some.replace(f"w{3 * i} ", f"v{i} ") for i in range(12)} | {20_000: some, 20_001: some, 20_002: "two words", 20_003: "Two, words", 20_004: ""}
    rows = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(rows).collect()}
    assert got == links(texts | more)
    kept = {r.doc_id for r in jaccard.keep_one(rows).collect()}
    assert kept == {d for d, (c, _) in got.items() if c == d}


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    odd = {-1: "<|endoftext|>Hi <|STARTOFTEXT|> it's", -2: "a" * 300 + " ΑΣ ΌΔΥΣΣΕΎΣ \x1c\x85½_#İ", -3: "", -4: "ab" * 3000}
    rows = spark.createDataFrame([*texts.items(), *odd.items()], "doc_id long, text string")
    for r in bpe.encode(rows, tokenizer_path()).collect():
        ids = reference.encode((texts | odd)[r.doc_id], add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids))
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)


def test_secrets(spark, texts):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in QUERIES["op4_secrets"](spark, SF).collect():
        t = texts[r.doc_id] or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        shown = [f"{k}:{s}:{e}" for s, _, k, e in sorted(base)]
        assert r.base_sha256 == sha(",".join(shown))
        assert set(shown) <= set(r.spans.split(",")) | {""}


def test_random_tokens(spark):
    rows = [(1, "key f33e61083db5dbdf4bd2369d2f80176e57f7fda2 end"), (2, "some_long_identifier_of_version_2"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1aaaaa")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_random for r in got} == {1: 1, 2: 0, 3: 0}


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict[int, list] = {}
    for r in QUERIES["op5_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, s, v in found)
        hits += len({f[2] for f in found} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 9 * len(got)


def test_toxicity_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)


def test_blocks_of_items(spark, texts):
    """The number of blocks does not change the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    whole = decontaminate.decontaminate(docs, items).select(columns).collect()
    parts = decontaminate.decontaminate(docs, items, block_bytes=2000).select(columns).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_an_id_with_many_items_is_spread(spark):
    """One item_id holds a third of the rows, others come repeatedly: blocks stay small and the result is that of one block."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [("hot" if i % 3 == 0 else f"i{i}", text(i)) for i in range(120)] + [("same", text(500))] * 60 + [(None, text(1)), ("none", None)]
    items = spark.createDataFrame(rows, "item_id string, text string")
    docs = spark.createDataFrame([(i, f"before {text(i)} after {text(i + 3)} {text(500)}") for i in range(0, 100, 9)] + [(1000, None), (1001, "clean words")], "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"]
    want = sorted(map(tuple, decontaminate.decontaminate(docs, items).select(columns).collect()))
    limit = 4_000
    assert sorted(map(tuple, decontaminate.decontaminate(docs, items, block_bytes=limit).select(columns).collect())) == want
    assert {"hot", "same"} <= set(want[0][3])
    blocks = [b.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for b in decontaminate.blocks(items, "item_id", "text", limit)]
    assert len(blocks) > 3 and max(blocks) <= 3 * limit
    # the repeated item stands in one block, once
    assert sum(b.filter("name = 'same'").count() for b in decontaminate.blocks(items, "item_id", "text", limit)) == 1


def test_matches_in_pieces(monkeypatch):
    """How many possible matches are compared at once does not change what is found."""
    passage = [" ".join(f"w{i % 40}" for i in range(k, k + 30)) for k in (0, 7, 11)]
    items = [*passage, "short item", "short item", ""]
    rarity = {int(h): 5 for h in decontaminate.item_shingles(decontaminate.item_words(items))[0]}
    index = decontaminate.build([str(i) for i in range(len(items))], items, rarity)
    docs = decontaminate.item_words([f"start {p} middle {p} short item {p[:50]}" for p in passage] + [None, "", "short"])
    find = lambda: sorted(zip(*(a.tolist() for a in decontaminate.matches(index, docs)), strict=True))
    whole = find()
    monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", 2)
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 3)
    assert find() == whole and len(whole) > 100


def test_main_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html_module.unescape(re.sub(r"</?b>", "", article)).replace("<br>", " ").replace("</p>", " ").replace("<p>", " ").replace("<h1>", " ").replace("</h1>", " ").split())
        assert r.text == want and r.n_chars == len(want)


def test_unmarked_page(spark):
    """A field that has learnt from marked pages reads one without marks, and drops adverts inside articles."""
    pages = [html.blocks(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    field = html.train(pages)
    body = "<p>" + "</p><p>".join(["A longer sentence that stands in the text of the page, as it goes on and on."] * 4) + "</p>"
    page = f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><div>{body}<div class='ad'>Buy now.</div></div><div class='comments'><p>Nice one.</p></div><footer>&copy; me</footer>"
    assert html.main_text(field, page) == " ".join(b.text for b in html.blocks(body))


def test_pseudonyms(spark, texts):
    p = pii.Permuter(b"key")
    text = "card 4111 1111 1111 1111 or 4111111111111111, on 2024-02-29 and 29.02.2024, DE89 3704 0044 0532 0130 00, 10.1.2.3, 078-05-1120, +1 (555) 555-0199, a.b9@x.org; not 4111111111111112, 2023-02-29, 300.1.1.1"
    new, spans = pii.pseudonymize(p, text)
    assert [k for k, _, _ in spans] == ["card", "card", "date", "date", "iban", "ip", "ssn", "phone", "mail"]
    assert all(x in new for x in ("4111111111111112", "2023-02-29", "300.1.1.1")) and len(new.split()) == len(text.split())
    cards = re.findall(r"4[0-9 ]{14,18}[0-9]", new)[:2]
    assert cards[0].replace(" ", "") == cards[1] and pii.luhn(cards[1]) and cards[1] != "4111111111111111"
    iso, german = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", new)[0], re.search(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", new)[0]
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(german, "%d.%m.%Y").date()
    assert sorted(p.permute(i, 1000, "f") for i in range(1000)) == list(range(1000))
    rows = QUERIES["op10_pseudonyms"](spark, SF).collect()
    for r in rows:
        assert (r.text, r.n_replaced) == (lambda n: (n[0], len(n[1])))(pii.pseudonymize(pii.Permuter(PII_KEY), texts[r.doc_id]))


def clear_values(text: str) -> list[tuple[int, int]]:
    """Brute force over all places, lengths and forms: what is a valid card, IPv4 address, security number or telephone number."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 and len(set(d)) > 1

    out = []
    for i in range(len(text)):
        for j in range(i + 7, min(len(text), i + 45) + 1):
            before, s, after = text[:i][-1:], text[i:j], text[j:j + 2]
            if before.isalnum() or after[:1].isalnum() or not s[-1].isdigit():
                continue
            d, joined = re.sub("[^0-9]", "", s), after[1:].isdigit()
            parts = s.split(".")
            card = re.fullmatch("[0-9]([ -]?[0-9])+", s) and 13 <= len(d) <= 19 and luhn(d)
            ip = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) and all(x == str(int(x)) and int(x) < 256 for x in parts) and not (after[:1] == "." and joined)
            ssn = re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", s) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" and not (after[:1] == "-" and joined)
            phone = re.fullmatch(r"(\+1 )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", s) and before != "." and not (after[:1] in list(".-") and joined)
            if card or ip or ssn or phone:
                out.append((i, j))
    return out


def test_no_value_in_clear():
    """Values next to other numbers: what a form refuses does not hide what stands in it or behind it."""
    p = pii.Permuter(b"key")
    for text, kinds in {
        "+1 (826) 555-4081 190.137.223.204": ["phone", "ip"], "7536784127813050 4845168114407329": ["card", "card"],
        "4111 1111 1111 1111 12/27": ["card"], "4111 1111 1111 1111 123": ["card"], "qty 2 4111 1111 1111 1111": ["card"],
        "AT61 1904 3002 3457 3201 HELP": ["iban"], "+1 (826) 555-4081 12 345": ["phone"],
    }.items():
        assert [k for k, _, _ in pii.pseudonymize(p, text)[1]] == kinds, text
    alone = pii.pseudonymize(p, "4111 1111 1111 1111")[0]
    assert alone + " 12/27" == pii.pseudonymize(p, "4111 1111 1111 1111 12/27")[0]
    rng = np.random.default_rng(3)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "4111-1111-1111-1111", "190.137.223.204", "+1 (826) 555-4081", "(826) 555-4081",
              "078-05-1120", "300.1.1.1", "4111111111111112", "666-12-3456", "2", "123", "12/27", "2023-02-29", "a1", "0.5", "99999"]
    for _ in range(1500):
        text = "".join(str(x) + str(rng.choice([" ", " ", ", ", "-", ".", "\n"])) for x in rng.choice(pieces, rng.integers(2, 6)))
        spans = pii.pseudonymize(p, text)[1]
        assert not [text[i:j] for i, j in clear_values(text) if all(e <= i or j <= s for _, s, e in spans)], (text, spans)


def test_phone_forms():
    """International and national numbers in any grouping; equal numbers have equal pseudonyms."""
    p = pii.Permuter(b"key")
    for text in ("+14155550123", "+1 4155550123", "+49 30 1234567", "+49301234567", "030 12345678", "0171-1234567", "(030) 12345678", "+44 (20) 79460958", "+358 9 1234567", "+33 1 23 45 67 89"):
        new, spans = pii.pseudonymize(p, f"call {text}, now")
        assert spans == [("phone", 5, 5 + len(text))] and new != f"call {text}, now", text
    same = {re.sub("[^0-9+]", "", pii.pseudonymize(p, t)[0]) for t in ("+14155550123", "+1 4155550123", "+1 (415) 555-0123", "+1-415-555-0123")}
    assert len(same) == 1 and same.pop().startswith("+1")
    assert pii.pseudonymize(p, "+14155550123 2024")[0] == pii.pseudonymize(p, "+14155550123")[0] + " 2024"
    for text in ("+1234567", "+1234567890123456", "12 345 67"):
        assert pii.pseudonymize(p, text) == (text, [])


def test_neighbours_hot_id(spark):
    """One id on a third of the rows, near the queries and all at the same or at slightly different places."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(800, 16))
    hot = vectors[0] + 0.01 * rng.normal(size=(400, 16)) * (np.arange(400) % 2)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5001, v.tolist()) for v in hot]
    got: dict[int, list] = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 100, 200)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 100, 200):
        near = {v: min(np.linalg.norm(hot - vectors[q], axis=1)) if v == 5001 else np.linalg.norm(vectors[v] - vectors[q]) for v in [*range(800), 5001] if v != q}
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(near[v] - s) < 1e-9 for _, v, s in found)
        assert len({f[1] for f in found} & set(sorted(near, key=near.get)[:10])) >= 9
    # All rows of a block as candidates: none is lost to the rough cut.
    forest = neighbours.Forest(np.array([r[1] for r in rows]), vectors.mean(0), np.array([r[0] for r in rows]))
    ids, _ = forest.nearest(vectors[0], np.arange(1, len(rows)), 10)
    near = {v: np.linalg.norm(vectors[v] - vectors[0]) for v in range(1, 800)} | {5001: min(np.linalg.norm(hot - vectors[0], axis=1))}
    assert ids.tolist() == sorted(near, key=near.get)[:10]


def test_no_page_to_learn_from(spark):
    """A table in which no page marks its article gets its texts all the same."""
    from collections import Counter

    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    bare = [(i, re.sub("(</?)(article|main)\\b", r"\1div", p)) for i, p in pages]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(bare, "page_id long, html string")).collect()}
    hits = found = wanted = 0
    for i, p in pages:
        want = Counter(" ".join(b.text for b in html.blocks(p) if html.by_rule(b)).split())
        text = Counter(got[i].split())
        hits, found, wanted = hits + (want & text).total(), found + text.total(), wanted + want.total()
    assert hits >= 0.95 * wanted and hits >= 0.95 * found
    long = "<p>" + "</p><p>".join(["A longer sentence that stands in the text of the page, as it goes on and on."] * 4) + "</p>"
    page = f"<nav><a href=x>Home</a></nav><div class=post><h1>Head of it</h1>{long}</div><div class=sidebar><p>See also this one, too.</p></div><footer>&copy; me</footer>"
    assert html.main_text(None, page) == " ".join(b.text for b in html.blocks("<h1>Head of it</h1>" + long))
