"""Ordered state over logs: rolling means, streaks, gauges, batches, retention, back-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.operators import ordered as O


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, depth: int = 1000) -> DataFrame:
    """Adds ``rolling_mean`` and ``n_in_window`` over the last ``depth`` rows of a key, ending at each row."""
    return O.scan(df, keys, order, O.Rolling(value, depth))


def last_n(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], n: int = 10) -> DataFrame:
    """The newest ``n`` rows per key, numbered oldest to newest.

    The rank filter is applied map-side before the shuffle, so a busy key sends ``n`` rows per task.
    """
    per_key = Window.partitionBy(*keys)
    ranked = df.withColumn("_back", F.row_number().over(per_key.orderBy(*newest_first))).filter(F.col("_back") <= n)
    kept = F.count(F.lit(1)).over(per_key)
    return ranked.withColumn("ord", kept - F.col("_back") + 1).drop("_back")


def failure_streaks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, disable_at: int = 3
) -> DataFrame:
    """Consecutive failures at each event and whether the key has ever reached the limit."""
    marked = df.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    return O.scan(marked, keys, order, O.Streak("_failed", disable_at)).drop("_failed")


def batch_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    positioned = O.with_position(df, keys, order)
    return positioned.withColumn("batch_no", F.floor((F.col("rn") - 1) / F.lit(size)).cast("bigint"))


def clamped_gauge(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column) -> DataFrame:
    """Running sum of +1/-1 steps that never falls below zero; a null step counts as 0."""
    return O.scan(df.withColumn("_step", step.cast("bigint")), keys, order, O.Gauge("_step")).drop("_step")


def lru_retain(accesses: DataFrame, key: str, at: str, max_size: int) -> DataFrame:
    """The keys a bounded cache still holds after all accesses."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"))
    return last.orderBy(F.desc("last_access"), F.asc(key)).limit(max_size)


def backoff_schedule(
    hits: DataFrame, keys: Sequence[str], order: Sequence[str], at: str,
    first_minutes: int = 15, cap_minutes: int = 120,
) -> DataFrame:
    """Cooldown after the k-th hit of a key: doubling from 15 minutes, never over two hours."""
    positioned = O.with_position(hits, keys, order, name="hit_no")
    doublings = F.least(F.col("hit_no") - 1, F.lit(30)).cast("double")
    minutes = F.least(F.lit(float(first_minutes)) * F.pow(F.lit(2.0), doublings), F.lit(float(cap_minutes)))
    out = positioned.withColumn("cooldown_minutes", minutes.cast("bigint"))
    until = F.col(at) + F.make_dt_interval(mins=F.col("cooldown_minutes").cast("int"))
    return out.withColumn("cooldown_until", until)
