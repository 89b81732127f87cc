"""Posts from search pages, files and ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from postlake.operators.store import keep_last
from postlake.schema import POST, all_strings
from postlake.sources import csv_split

#: The ten sample texts generated posts cycle through.
SAMPLE_TEXTS = (
    "I absolutely love this product! It's amazing! 😊",
    "This is terrible. Worst experience ever. 😠",
    "It's okay, nothing special. 🤷",
    "Great service, would recommend! 👍",
    "Very disappointed with the quality. 👎",
    "Average product, does the job. 😐",
    "Excellent! Exceeded my expectations! ⭐",
    "Poor customer service, not happy. 😞",
    "Good value for money. 🙂",
    "Waste of money, regret buying. 😤",
)


def flatten(source: DataFrame) -> DataFrame:
    """One flat post per source post; counters a page does not know become 0."""
    counter = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return source.select(
        "id", "text", "created_at",
        F.col("user.name").alias("user"), F.col("user.screen_name").alias("username"),
        "retweet_count", "favorite_count", *[counter(c) for c in ("view_count", "reply_count", "quote_count")],
        "lang",
    )


def paged(pages: DataFrame, count: int, page: str = "page", position: str = "pos") -> DataFrame:
    """First arrival of every id, in page order, up to the target."""
    first = keep_last(pages, ["id"], [F.asc(page), F.asc(position)])
    return first.orderBy(page, position).limit(max(count, 1))


def read_json_array(spark: SparkSession, path: str, schema: StructType = POST) -> DataFrame:
    """Files that hold one JSON array each; a file that holds another JSON value, or nothing, yields nothing.

    Text that is not JSON and records that do not fit the schema raise; a null among the records is no record.
    A file is parsed as a whole, so arrays should be bounded, as ``write_json_array`` makes them.
    """
    files = spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"\S"))
    rows = ArrayType(schema)
    parsed = F.from_json("value", rows, {"mode": "FAILFAST"})
    broken = F.raise_error(F.concat(F.lit("not JSON: "), F.input_file_name())).cast(rows)
    found = F.when(F.col("value").rlike(r"^\s*\["), parsed).when(F.try_parse_json("value").isNull(), broken)
    return files.select(F.explode(found).alias("row")).filter(F.col("row").isNotNull()).select("row.*")


def read_csv(spark: SparkSession, path: str, schema: StructType = POST) -> DataFrame:
    """Header row, every column as text. A file of any size is read by many tasks, also with line ends in quotes."""
    return csv_split.rows(spark, path, all_strings(schema))


def sql_with_params(
    spark: SparkSession, views: Mapping[str, DataFrame], statement: str, params: Sequence = ()
) -> DataFrame:
    """Ad-hoc SQL with positional ``?`` markers over the given tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=list(params))


def synthetic_posts(ids: DataFrame, number: str, base: Column) -> DataFrame:
    """A generated post for every row number: texts in turn, one minute back per row."""
    n = F.col(number)
    from postlake.functions.text import rule_label

    texts = F.array(*[F.lit(t) for t in SAMPLE_TEXTS])
    text = F.element_at(texts, (n % len(SAMPLE_TEXTS)).cast("int") + 1)
    at = F.timestamp_micros(F.unix_micros(base) - n * F.lit(60_000_000))
    posts = ids.select(
        F.concat(F.lit("tweet_"), n.cast("string")).alias("id"), text.alias("text"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.concat(F.lit("user_"), (n % 100).cast("string")).alias("username"), F.lit("en").alias("lang"),
        (n % 50).alias("retweet_count"), (n % 100).alias("favorite_count"),
    )
    return posts.withColumn("sentiment_label", rule_label("text"))
