"""A training-data pipeline over ``documents``: five stages, each over all that the one before kept.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> BPE. All but the last return the columns
of ``documents``; each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.llm import bpe, decontaminate, jaccard, lines, toxicity
from postlake.llm.queries import tokenizer_path
from postlake.session import remove, scratch_path, scratch_scope


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = toxicity.score(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that is left with nothing goes too."""
    kept = lines.dedup_lines(docs).filter("n_lines = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.filter("not contaminated").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokens),
]

#: A trained classifier, a similarity join and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch folders and its input from the stage before go when its result is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
