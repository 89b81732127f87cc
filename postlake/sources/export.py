"""Exports. Every writer is a distributed write; no row passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.operators.store import post_metadata
from postlake.schema import SCORE


#: How CSV is written, by batch and stream: quotes where needed, quotes doubled, blanks kept, a null as an empty field.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

#: Rows of one JSON array at most, and bytes of its rows; a reader parses an array as a whole.
ARRAY_ROWS, ARRAY_BYTES = 100_000, 2 << 20


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Header, quotes where needed, quotes doubled; a null is an empty field."""
    df.write.options(**CSV_OPTIONS).option("compression", compression).csv(path)


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("ignoreNullFields", False).option("compression", compression).json(path)


def write_json_array(df: DataFrame, path: str, pretty: bool = False, max_rows: int = ARRAY_ROWS, max_bytes: int = ARRAY_BYTES) -> None:
    """Each file is one JSON array of at most ``max_rows`` rows and ``max_bytes`` bytes of rows; a longer row is an array of its own."""
    options = {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})}
    text = F.to_json(F.struct("*"), options)
    rows = df.select(text.alias("value")).withColumn("size", F.octet_length("value"))

    def array(held: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"value": ["[\n" + ",\n".join(held) + "\n]" if held else "[]"]})

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_bytes, written = [], 0, False
        for batch in batches:
            for line, size in zip(batch["value"], batch["size"], strict=True):
                if held and (len(held) == max_rows or n_bytes + size > max_bytes):
                    yield array(held)
                    held, n_bytes, written = [], 0, True
                held.append(line)
                n_bytes += size
        if held or not written:
            yield array(held)

    # An array is one record of the writer, and a file holds one record.
    rows.mapInPandas(wrap, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.option("compression", compression).parquet(path)


def export_stats(df: DataFrame) -> DataFrame:
    """Rows, UTF-8 bytes of their JSON form, and the average."""
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_bytes"),
    )


def write_fanout(batch: DataFrame, base: str, mode: str = "append") -> dict[str, str]:
    """A scored batch becomes posts, scores and metadata; a post without a score gets no score row.

    The batch is persisted because three writes read it; a lost executor recomputes its part.
    """
    paths = {name: f"{base}/{name}" for name in ("posts", "scores", "metadata")}
    scores = [c for c in batch.columns if c.startswith("sentiment_")]
    cached = batch.persist()
    try:
        cached.drop(*scores).write.mode(mode).parquet(paths["posts"])
        have = {c.removeprefix("sentiment_") for c in scores}
        columns = [
            (F.col(f"sentiment_{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCORE.fields[1:]
        ]
        scored = cached.filter(F.col("sentiment_label").isNotNull()).select(F.col("id").alias("tweet_id"), *columns)
        scored.write.mode(mode).parquet(paths["scores"])
        post_metadata(cached).write.mode(mode).parquet(paths["metadata"])
    finally:
        cached.unpersist()
    return paths


def append_searches(searches: DataFrame, path: str) -> None:
    """Append searches (query, count, product, fetched_count) to the history, stamped with the time of writing.

    All searches of a call share its files, so a history stays in few files when searches are handed over in batches.
    """
    columns = [
        F.col("query").cast("string").alias("query"), F.col("count").cast("bigint").alias("count"),
        F.col("product").cast("string").alias("product"), F.col("fetched_count").cast("bigint").alias("fetched_count"),
    ]
    searches.select(*columns, F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss").alias("search_time")).write.mode("append").parquet(path)


def append_search(spark: SparkSession, path: str, query: str, count: int, product: str, fetched: int) -> None:
    """One line of search history."""
    row = spark.range(1).select(
        F.lit(query).alias("query"), F.lit(count).alias("count"), F.lit(product).alias("product"), F.lit(fetched).alias("fetched_count")
    )
    append_searches(row, path)
