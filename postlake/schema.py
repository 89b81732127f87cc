"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


COUNTERS = ("retweet_count", "favorite_count", "view_count", "reply_count", "quote_count")

#: One superset of the stored post.
POST = _struct(
    ("id", _S), ("text", _S), ("original_text", _S), ("created_at", _S), ("user_name", _S), ("username", _S),
    *[(c, _L) for c in COUNTERS], ("lang", _S), ("query", _S), ("fetched_at", _S), ("cleaned_text", _I),
)

#: What one search page delivers, before flattening.
SOURCE_POST = _struct(
    ("id", _S), ("text", _S), ("created_at", _S), ("lang", _S),
    *[(c, _L) for c in COUNTERS],
    ("user", _struct(("name", _S), ("screen_name", _S))),
)

SCORE = _struct(
    ("tweet_id", _S), ("method", _S), ("label", _S), ("compound", _D), ("positive", _D), ("negative", _D),
    ("neutral", _D), ("polarity", _D), ("subjectivity", _D), ("analyzed_at", _S),
)

METADATA = _struct(("tweet_id", _S), ("metadata_type", _S), ("value", _S))

SEARCH_HISTORY = _struct(("query", _S), ("count", _L), ("product", _S), ("fetched_count", _L), ("search_time", _S))

TTL_ENTRY = _struct(("key", _S), ("value", _S), ("created_at", T.TimestampType()), ("expires_at", T.TimestampType()))


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
