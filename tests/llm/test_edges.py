"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

from postlake.llm import bpe, decontaminate, html, jaccard, lines, neighbours, pii, secrets, suffix, toxicity
from postlake.llm.queries import tokenizer_path
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} is here\nand" for i in range(20_000))
ROWS = [
    (1, None), (2, ""), (None, "a text without an id that is long enough to be compared with other texts of the table"), (3, LONG), (3, LONG),
    (4, "same lines\nof text\nin two rows\n"), (4, "same lines\nof text\nin two rows\n"), (5, "%%% ###"), (None, None), (6, "x"),
]
CLASHES = ("n_tokens", "n_removed", "spans", "score", "n_words", "_spans", "_id", "row", "key", "path", "component", "n_links")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


OPERATORS = {
    "suffix": suffix.dedup, "jaccard": jaccard.join, "keep_one": None, "bpe": lambda d: bpe.digests(d, tokenizer_path()),
    "secrets": secrets.scan, "lines": lines.dedup_lines, "pii": lambda d: pii.replace(d, b"k"),
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([(3, 1), (4, 0), (None, 1), (4, None)], "doc_id long, toxic int")),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "same lines of text"), (None, "x"), (2, None), (3, "")], "item_id long, text string")),
}
OPERATORS.pop("keep_one")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(docs, name):
    assert len(OPERATORS[name](docs).collect()) == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_results(docs):
    kept = suffix.dedup(docs).select("doc_id", "n_bytes", "n_removed").collect()
    assert all(r.n_removed == 0 for r in kept) and sum(r.n_bytes == 0 for r in kept) == 3
    linked = {(r.doc_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert {(3, 1), (4, 1), (1, 0), (2, 0), (5, 0), (6, 0)} <= linked
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == sorted(["1", "2", "None", "3", "4", "5", "None", "6"])
    assert all(r.text == t for r, (_, t) in zip(lines.dedup_lines(docs).filter("doc_id = 4").collect(), [ROWS[5]] * 2))
    hit = decontaminate.decontaminate(docs, docs.sparkSession.createDataFrame([(1, "Same, lines OF text")], "item_id long, text string"))
    assert [(r.n_hit, r.contaminated) for r in hit.filter("doc_id = 4").collect()] == [(4, True)] * 2


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (None, [1.0, 1.0]), (6, [0.0, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 8), (3, 6)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<article><p>Text &amp; more.</p>"), (3, "u", "<p>no end <script>x"), (3, "u", "< <<>&#0;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("mine"))
    assert {r.page_id: r.text for r in html.extract(df).collect()}[None] == "Text & more."
    assert html.extract(df).count() == 5 and html.extract(df.limit(0)).count() == 0


def test_stages_keep_columns(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = after
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_open_heads_and_dotted_capitals():
    read = lambda page: [b.text for b in html.blocks(page)]
    assert read("İ" * 5 + "<script>x</script>Hello world") == ["İ" * 5, "Hello world"]
    assert read("<p>İİİİ</p><STYLE>a</Style><iframe>b</IFRAME><p>Text</p><script>if (a</x) code()</script>") == ["İİİİ", "Text"]
    assert read("<html><head><title>t</title><meta charset=x><article><h1>Head</h1><p>Text</p></article>") == ["Head", "Text"]
    assert read("<head><link href=x><template><p>no</p></template><script>x</script><p>Text<p>more") == ["Text", "more"]
    assert read("<head><title>t</title>\n<!-- c --> Text <b>bold</b></html>") == ["Text bold"]
    assert read("<head><title>t</title></head><body><p>Text</body>") == ["Text"]
