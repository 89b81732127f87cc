"""Metrics as aggregates over append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.marks import alive, ratio

#: Default bucket bounds in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

SEVERITY = {"healthy": 0, "unknown": 1, "degraded": 2, "unhealthy": 3}


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))


def counters_by_dimension(log: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One counter per value of each dimension, plus the total.

    The log is counted once per combination; the grouping sets run on that small result.
    """
    combos = log.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    sets = [[d] for d in dimensions] + [[]]
    columns = [F.col(d) for d in dimensions]
    grouped = combos.groupingSets([[F.col(d) for d in s] for s in sets], *columns).agg(
        F.sum("n").alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    name = F.lit("total")
    value = F.lit("")
    for d in dimensions:
        here = F.col(f"_g_{d}") == 0
        name = F.when(here, d).otherwise(name)
        value = F.when(here, F.coalesce(F.col(d).cast("string"), F.lit("(none)"))).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def rate(log: DataFrame, keys: Sequence[str], good: Column, bad: Column | None = None) -> DataFrame:
    """Share of ``good`` among good and bad rows, 0 where there are none."""
    against = ~good if bad is None else bad
    counted = log.groupBy(*keys).agg(_n(good).alias("hits"), _n(against).alias("misses"))
    return counted.withColumn("hit_rate", ratio(F.col("hits").cast("double"), F.col("hits") + F.col("misses")))


def timing_summary(log: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    total = F.sum(value)
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_time"), F.min(value).alias("min_time"),
        F.max(value).alias("max_time"), F.coalesce(F.try_divide(F.count(F.lit(1)), total), F.lit(0.0)).alias("per_second"),
    )


def latency_histogram(
    log: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative ``le`` buckets. One pass with a counter per bound; only the result is unpivoted."""
    edges = [(str(float(b)), F.col(value) <= b) for b in bounds] + [("+Inf", F.col(value).isNotNull())]
    wide = log.groupBy(*keys).agg(
        *[_n(cond).alias(f"_b{i}") for i, (_, cond) in enumerate(edges)],
        F.sum(value).alias("total_time"), F.count(value).alias("n"),
    )
    cells = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, (le, _) in enumerate(edges)])
    return wide.select(*keys, F.explode(cells).alias("_c"), "n", "total_time").select(
        *keys, "_c.le", "_c.bucket", "n", "total_time"
    )


def source_reliability(log: DataFrame, source: str = "source") -> DataFrame:
    """Totals per source and overall, rolled up from the per-source rows."""
    per_source = log.groupBy(source).agg(
        F.count(F.lit(1)).alias("requests"),
        _n(F.col("status") == "success").alias("successes"),
        _n(F.col("status") == "rate_limited").alias("rate_limit_hits"),
        _n(F.col("status") == "error").alias("warnings"),
    )
    rolled = per_source.rollup(source).agg(
        *[F.sum(c).alias(c) for c in ("requests", "successes", "rate_limit_hits", "warnings")],
        F.grouping(source).alias("_all"),
    )
    percent = F.round(ratio(F.col("successes").cast("double"), F.col("requests")) * 100, 2)
    label = F.when(F.col("_all") == 1, "(all)").otherwise(F.coalesce(source, F.lit("(none)")))
    return rolled.select(
        label.alias(source), "requests", "successes", "rate_limit_hits", "warnings", percent.alias("success_percent")
    )


def ttl_stats(entries: DataFrame, now: Column) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("total_items"), _n(alive(now, "expires_at")).alias("valid_items"),
        _n(~alive(now, "expires_at")).alias("expired_items"),
    )


def run_stats(run_log: DataFrame, rows: str = "rows", millis: str = "millis") -> DataFrame:
    """Over a log with one row per batch."""
    base = run_log.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("rows_processed"), F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum(millis), F.lit(0.0)).alias("total_ms"),
    )
    n, ms = F.col("rows_processed").cast("double"), F.col("total_ms")
    return base.select(
        "rows_processed", "batches", ratio(n, F.col("batches")).alias("avg_batch_size"),
        ratio(ms, n).alias("avg_ms_per_row"), ratio(n * 1000, ms).alias("rows_per_second"),
    )


def component_health(status_log: DataFrame, component: str, status: str, latest: Column) -> DataFrame:
    """Latest status per component beside the overall verdict.

    The verdict is the worst latest status (unhealthy before degraded; anything else is healthy).
    Components stay rows instead of being gathered into lists.
    """
    last = status_log.groupBy(component).agg(
        F.max_by(status, latest).alias("status"), F.count(F.lit(1)).alias("n_results")
    )
    code = F.lit(0)
    for name, level in SEVERITY.items():
        code = F.when(F.col("status") == name, level).otherwise(code)
    # Reading the count here keeps both uses of ``last`` alike, so the log is scanned once.
    worst = last.agg(F.max(F.when(F.col("n_results") > 0, code)).alias("_w")).scalar()
    overall = F.when(worst == 3, "unhealthy").when(worst == 2, "degraded").otherwise("healthy")
    return last.select(F.col(component).alias("component"), "status", "n_results", overall.alias("overall_status"))


def limiter_stats(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Allowed, denied and waiting totals of replayed requests."""
    allowed = F.col("allowed") == 1
    base = decisions.groupBy(*keys).agg(
        _n(allowed).alias("requests_allowed"), _n(~allowed).alias("requests_denied"),
        _n(allowed & (F.col("delay_s") > 0)).alias("requests_waited"),
        F.coalesce(F.sum(F.when(allowed, F.col("delay_s"))), F.lit(0.0)).alias("total_wait_s"),
    )
    whole = F.col("requests_allowed") + F.col("requests_denied")
    return base.withColumn("denial_rate", ratio(F.col("requests_denied").cast("double"), whole))
