"""Joins: posts with scores, skew-safe lookups, tiers, reuse, orphans and cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.marks import alive

#: A key is hot above 1/1000 of all rows, so there can never be a thousand hot keys.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of the rows; fewer than HOT_SHARE rows by construction.

    ``counts`` (key, _n) saves the pass over ``df`` when the rows per key are known already.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    total = counts.agg(F.sum("_n").alias("_all")).scalar()
    return counts.filter((F.col("_n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(
        F.col(key).alias("_hot_key")
    )


def lookup_left_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str], salts: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join against a table with one row per key when some left keys may be very hot.

    Rows of hot keys are spread over ``salts`` sub-keys and only the hot rows of the right side are
    repeated, so both sides still meet in one shuffle join.
    """
    spark = left.sparkSession
    salts = salts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    hot = F.broadcast(hot_keys(left, key, counts))
    salt = F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0))
    spread = left.join(hot, left[key] == F.col("_hot_key"), "left").withColumn("_salt", salt.cast("int")).drop("_hot_key")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeats = F.when(F.col("_hot_key").isNotNull(), every).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, right[key] == F.col("_hot_key"), "left").withColumn("_salt", F.explode(repeats))
    return spread.join(repeated.drop("_hot_key"), [key, "_salt"], "left").drop("_salt")


def posts_with_scores(posts: DataFrame, scores: DataFrame, how: str = "left") -> DataFrame:
    """Posts with flat ``sentiment_*`` columns; one score row per post."""
    flat = scores.select(
        F.col("tweet_id").alias("_tweet_id"),
        F.col("method").alias("sentiment_method"),
        *[
            F.col(c).alias(f"sentiment_{c}")
            for c in ("label", "compound", "positive", "negative", "neutral", "polarity", "subjectivity")
        ],
    )
    return posts.join(flat, posts["id"] == flat["_tweet_id"], how).drop("_tweet_id")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parents.select(F.col(parent_key).alias("_parent"))
    return children.join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, child_key: str, deleted_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) when posts are deleted with everything hanging on them."""
    keys = deleted.select(F.col(deleted_key).alias("_deleted"))
    same = F.col(child_key) == F.col("_deleted")
    return children.join(keys, same, "left_anti"), children.join(keys, same, "left_semi")


def two_tier_lookup(requests: DataFrame, inner: DataFrame, outer: DataFrame, key: str, now: Column, spread_by: Sequence[str]) -> DataFrame:
    """Inner tier if its entry is still alive, else the outer one, else a miss.

    Both tiers are folded into one row per key first, so the requests are shuffled once.
    """
    first = inner.filter(alive(now, "expires_at", inclusive=False)).select(key, F.col("value").alias("_v1"))
    second = outer.filter(alive(now, "expires_at")).select(key, F.col("value").alias("_v2"))
    tiers = first.join(second, key, "full").withColumns(
        {
            "value": F.coalesce("_v1", "_v2"),
            "tier": F.when(F.col("_v1").isNotNull(), "L1").when(F.col("_v2").isNotNull(), "L2"),
        }
    ).drop("_v1", "_v2")
    found = lookup_left_join(requests, tiers, key, spread_by)
    return found.withColumn("tier", F.coalesce("tier", F.lit("miss")))


def reuse_results(requests: DataFrame, stored: DataFrame, now: Column, spread_by: Sequence[str]) -> DataFrame:
    """Requests with the stored result of the same key when it is still alive."""
    usable = stored.filter(alive(now, "expires_at")).select("result_key", F.col("value").alias("result"))
    found = lookup_left_join(requests, usable, "result_key", spread_by)
    return found.withColumn("reused", F.col("result").isNotNull().cast("int"))
