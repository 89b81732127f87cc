"""SQL names for the column functions, so ad-hoc SQL can use them without any Python worker.

Each name stands for a column function of this package: the body of the SQL function is written from that column, so a
rule is stated once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from postlake.functions import marks as M, packing as K, periods as P, text as T

_AT = "ts TIMESTAMP"
#: name -> (parameters, column over columns of these names)
SQL_FUNCTIONS: dict[str, tuple[str, Callable[[], Column]]] = {
    "post_clean": ("t STRING", lambda: T.clean_text("t")),
    "post_hashtags": ("t STRING", lambda: T.hashtags("t")),
    "post_mentions": ("t STRING", lambda: T.mentions("t")),
    "post_urls": ("t STRING", lambda: T.urls("t")),
    "post_metadata": ("t STRING", lambda: T.metadata_entries("t")),
    "post_safe_name": ("t STRING", lambda: T.safe_name("t")),
    "post_output_name": (f"t STRING, {_AT}, extension STRING", lambda: F.concat(T.output_name("t", "ts", ""), F.col("extension"))),
    "fold_ascii": ("t STRING", lambda: T.fold_ascii("t")),
    "query_type": ("t STRING", lambda: T.query_type("t")),
    "rule_label": ("t STRING", lambda: T.rule_label("t")),
    "label_compound": ("v DOUBLE", lambda: M.label_from_compound("v")),
    "label_polarity": ("v DOUBLE", lambda: M.label_from_polarity("v")),
    "threshold_band": ("v DOUBLE", lambda: M.threshold_band("v")),
    "size_mb": ("b DOUBLE", lambda: M.size_mb("b")),
    "guarded_ratio": ("a DOUBLE, b DOUBLE", lambda: M.ratio(F.col("a"), F.col("b"))),
    "search_result_key": ("a STRING, b STRING, c STRING", lambda: M.result_key("search", "a", "b", "c")),
    "effective_ttl": ("ttl INT, usual INT", lambda: F.coalesce(F.nullif("ttl", F.lit(0)), F.col("usual"))),
    "search_expires_at": (f"{_AT}, ttl INT", lambda: M.expires_at("ts", "ttl", M.TTL_SEARCH)),
    "score_expires_at": (f"{_AT}, ttl INT", lambda: M.expires_at("ts", "ttl", M.TTL_SCORE)),
    "user_expires_at": (f"{_AT}, ttl INT", lambda: M.expires_at("ts", "ttl", M.TTL_USER)),
    "still_alive": (f"{_AT}, expiry TIMESTAMP", lambda: M.alive(F.col("ts"), "expiry")),
    "parse_iso": ("t STRING", lambda: P.parse_iso("t")),
    "shard_key": ("t STRING, id STRING", lambda: P.shard_key("t", "id", 4)),
    "shard_key_monthly": ("t STRING, id STRING", lambda: P.shard_key("t", "id", 12)),
    "shards_in_range": ("a STRING, b STRING", lambda: P.shards_in_range("a", "b", 4)),
    "packed_ratio": ("t STRING", lambda: K.estimated_ratio("t")),
}

_TEXT = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(>=|<=|<=>|[<>=+\-*/%]|\bor|\band)(?=\()")


def body_of(column: Column) -> str:
    """SQL text of a column; operators, which print as calls, become calls by their quoted names."""
    parts = _TEXT.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`", p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    for name, (params, make) in SQL_FUNCTIONS.items():
        column = make()
        typed = spark.createDataFrame([], params.replace(" STRING", " string"))
        result = typed.select(column.alias("r")).schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body_of(column)}")
    return sorted(SQL_FUNCTIONS)
