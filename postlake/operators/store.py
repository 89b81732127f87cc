"""The stored tables: selection, upsert, counts and sentiment statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql.types import MapType
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.functions.text import metadata_entries
from postlake.operators.ordered import Position, scan
from postlake.schema import COUNTERS, POST


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(columns or ("*",)))


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def where_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """An empty list selects nothing."""
    return df.filter(F.col(column).isin(list(values)))


def where_equal(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """``None`` or empty means no restriction."""
    return df.filter(F.col(column) == value) if value else df


def page(df: DataFrame, *order: Column, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows in order, from ``offset`` on. All rows behind an offset are numbered in slices and never meet in one task."""
    if offset and not limit:
        return scan(df, [], order, Position("_place")).filter(F.col("_place") > offset).drop("_place")
    out = df.orderBy(*order) if order else df
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def between_dates(posts: DataFrame, start: str, end: str, limit: int | None = 1000) -> DataFrame:
    """Inclusive range on the stored date text, newest first."""
    hit = posts.filter(F.col("created_at").between(start, end))
    return page(hit, F.col("created_at").desc_nulls_last(), F.col("id").asc(), limit=limit)


def normalized(posts: DataFrame) -> DataFrame:
    """Fill the defaults of a stored post and mark whether its text was cleaned."""
    filled = posts.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in COUNTERS if c in posts.columns})
    if "original_text" in posts.columns:
        filled = filled.withColumn("cleaned_text", (F.coalesce("original_text", F.lit("")) != "").cast("int"))
    return filled


def keep_last(rows: DataFrame, keys: Sequence[str], latest_first: Sequence[Column]) -> DataFrame:
    """Last writer wins, whole row. Copies beyond the first are dropped before the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest_first)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The table after writing ``incoming`` over it; columns a writer left out return to their defaults.

    A null ``seq`` is the oldest. Of rows with one ``seq`` the incoming one wins, and among those a digest of the row
    decides, so that the result does not depend on the order of the rows.
    """
    marked = current.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
    latest = [F.desc_nulls_last(seq), F.desc("_incoming"), F.desc(row_digest(marked))]
    return normalized(keep_last(marked, keys, latest).drop("_incoming"))


def row_digest(rows: DataFrame) -> Column:
    """A number that settles ties between rows that differ."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(rows.schema[c].dataType, MapType) else F.col(c) for c in sorted(rows.columns)])


def nest_sentiment(joined: DataFrame) -> DataFrame:
    """Collect the flat score columns into one struct, null when the post has no score at all."""
    flat = [c for c in joined.columns if c.startswith("sentiment_")]
    packed = F.struct(*[F.col(c).alias(c.removeprefix("sentiment_")) for c in flat])
    scored = F.coalesce(*[F.col(c).cast("string") for c in flat]).isNotNull()
    return joined.withColumn("sentiment", F.when(scored, packed)).drop(*flat)


def post_metadata(posts: DataFrame, source: Column | None = None) -> DataFrame:
    """One row per hashtag, mention and link. Cleaned text has none left, so the original is read first."""
    text = F.coalesce(F.nullif("original_text", F.lit("")), F.col("text")) if source is None else source
    return posts.select(F.col("id").alias("tweet_id"), F.explode(metadata_entries(text)).alias("_m")).select(
        "tweet_id", "_m.metadata_type", "_m.value"
    )


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def sentiment_stats(scores: DataFrame, posts: DataFrame, query: str | None = None) -> DataFrame:
    """Per label: rows and average scores, over scores whose post exists."""
    hit = where_equal(posts, "query", query).select("id")
    joined = scores.join(hit, scores["tweet_id"] == hit["id"], "inner")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("compound").alias("avg_compound"), F.avg("polarity").alias("avg_polarity")
    )


def sentiment_overall(scores: DataFrame, posts: DataFrame, query: str | None = None) -> DataFrame:
    hit = where_equal(posts, "query", query).select("id")
    joined = scores.join(hit, scores["tweet_id"] == hit["id"], "inner")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.avg("compound").alias("avg_compound"), F.avg("polarity").alias("avg_polarity")
    )


def stored_posts(posts: DataFrame) -> DataFrame:
    """Rows in the declared shape, missing columns as null."""
    have = set(posts.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in POST.fields
    ]
    return normalized(posts.select(*columns))
