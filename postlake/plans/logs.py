"""Request-log, cache and status analytics, ordered state over logs, and bucket replays."""

from pyspark.sql import functions as F

from postlake.functions.marks import threshold_band
from postlake.operators import limits, logs as G, windows as W
from postlake.operators.store import keep_last
from postlake.plans.fixtures import iso, now
from postlake.plans.registry import query

R6 = lambda c: F.round(c, 6)


@query(
    "agg_counters_by_dim", "log",
    """SELECT CASE WHEN grouping(endpoint) = 0 THEN 'endpoint' WHEN grouping(status) = 0 THEN 'status'
        WHEN grouping(source) = 0 THEN 'source' ELSE 'total' END AS dimension,
      coalesce(endpoint, status, source, '') AS value, count(*) AS n
      FROM log GROUP BY GROUPING SETS ((endpoint), (status), (source), ())""",
)
def _(t):
    return G.counters_by_dimension(t.log(), ["endpoint", "status", "source"])


@query(
    "agg_hit_rate", "log",
    """SELECT source, count(*) FILTER (status = 'success') AS hits, count(*) FILTER (status = 'rate_limited') AS misses,
      round(coalesce(hits::DOUBLE / nullif(hits + misses, 0), 0), 6) AS hit_rate FROM log GROUP BY 1""",
)
def _(t):
    rate = G.rate(t.log(), ["source"], F.col("status") == "success", F.col("status") == "rate_limited")
    return rate.withColumn("hit_rate", R6("hit_rate"))


@query(
    "agg_timing_summary", "log",
    """SELECT endpoint, count(*) AS n, round(avg(response_time), 6) AS mean_time, round(min(response_time), 6) AS min_time,
      round(max(response_time), 6) AS max_time, round(count(*) / sum(response_time), 4) AS per_second FROM log GROUP BY 1""",
)
def _(t):
    s = G.timing_summary(t.log(), ["endpoint"], "response_time")
    return s.select("endpoint", "n", *[R6(c).alias(c) for c in ("mean_time", "min_time", "max_time")], F.round("per_second", 4).alias("per_second"))


_BOUNDS = ", ".join(f"('{float(b)}', {b}::DOUBLE)" for b in G.LATENCY_BOUNDS)


@query(
    "agg_latency_histogram", "log",
    f""", bounds(le, v) AS (VALUES {_BOUNDS}, ('+Inf', 'infinity'::DOUBLE))
    SELECT endpoint, le, count(*) FILTER (response_time <= v) AS bucket, count(response_time) AS n,
      round(sum(response_time), 6) AS total_time FROM log CROSS JOIN bounds GROUP BY endpoint, le""",
)
def _(t):
    return G.latency_histogram(t.log(), ["endpoint"], "response_time").withColumn("total_time", R6("total_time"))


@query(
    "agg_source_reliability", "log",
    """SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, count(*) AS requests,
      count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'rate_limited') AS rate_limit_hits,
      count(*) FILTER (status = 'error') AS warnings,
      round(count(*) FILTER (status = 'success')::DOUBLE / count(*) * 100, 2) AS success_percent FROM log GROUP BY ROLLUP (source)""",
)
def _(t):
    return G.source_reliability(t.log())


_LAST_SET = """, entries AS (SELECT * FROM cache_sets QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1)"""


@query(
    "agg_ttl_stats", "cache_sets",
    _LAST_SET + """ SELECT count(*) AS total_items, count(*) FILTER (TIMESTAMP '2024-01-15 00:00:00' <= expires_at) AS valid_items,
      count(*) FILTER (TIMESTAMP '2024-01-15 00:00:00' > expires_at) AS expired_items FROM entries""",
)
def _(t):
    entries = keep_last(t.cache_sets(), ["key"], [F.desc("created_at"), F.desc("event_id")])
    return G.ttl_stats(entries, now())


@query(
    "agg_run_stats", "log",
    """, runs AS (SELECT endpoint, date_trunc('day', ts) AS d, count(*) AS n, sum(response_time * 1000) AS ms FROM log GROUP BY 1, 2)
    SELECT sum(n)::BIGINT AS rows_processed, count(*) AS batches, round(sum(n)::DOUBLE / count(*), 6) AS avg_batch_size,
      round(sum(ms) / sum(n), 6) AS avg_ms_per_row, round(sum(n) * 1000 / sum(ms), 4) AS rows_per_second FROM runs""",
)
def _(t):
    runs = t.log().groupBy("endpoint", F.date_trunc("day", "ts").alias("d")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("response_time") * 1000).alias("millis")
    )
    s = G.run_stats(runs)
    return s.select(
        "rows_processed", "batches", R6("avg_batch_size").alias("avg_batch_size"), R6("avg_ms_per_row").alias("avg_ms_per_row"),
        F.round("rows_per_second", 4).alias("rows_per_second"),
    )


_BAND = "CASE WHEN usage > 90 THEN 'unhealthy' WHEN usage > 80 THEN 'degraded' ELSE 'healthy' END"


@query(
    "agg_component_health", "statuses",
    f""", latest AS (SELECT component, {_BAND} AS status, count(*) OVER (PARTITION BY component) AS n_results FROM statuses
      QUALIFY row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) = 1)
    SELECT *, CASE WHEN (SELECT count(*) FROM latest WHERE status = 'unhealthy') > 0 THEN 'unhealthy'
      WHEN (SELECT count(*) FROM latest WHERE status = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS overall_status FROM latest""",
)
def _(t):
    log = t.statuses().withColumn("status", threshold_band("usage"))
    return G.component_health(log, "component", "status", F.struct("ts", "event_id"))


@query("fn_threshold_band", "statuses", f"SELECT event_id, component, {_BAND} AS band FROM statuses")
def _(t):
    return t.statuses().select("event_id", "component", threshold_band("usage").alias("band"))


@query(
    "win_rolling_mean", "log",
    """SELECT event_id, endpoint, round(avg(response_time) OVER w * count(*) OVER w, 5) / count(*) OVER w AS rolling_mean,
      count(*) OVER w AS n_in_window FROM log
      WINDOW w AS (PARTITION BY endpoint ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    log = t.log().select("endpoint", "ts", "event_id", "response_time")
    means = W.rolling_mean(log, ["endpoint"], ["ts", "event_id"], "response_time", 1000)
    # The times have five decimals, so their sum can be rounded without ties and the mean compared exactly.
    exact = F.round(F.col("rolling_mean") * F.col("n_in_window"), 5) / F.col("n_in_window")
    return means.select("event_id", "endpoint", exact.alias("rolling_mean"), "n_in_window")


@query(
    "win_last_n", "statuses",
    f"""SELECT component, event_id, band, row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS ord FROM (
      SELECT *, {_BAND} AS band FROM statuses QUALIFY row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) <= 10)""",
)
def _(t):
    log = t.statuses().withColumn("band", threshold_band("usage"))
    return W.last_n(log, ["component"], [F.desc("ts"), F.desc("event_id")], 10).select("component", "event_id", "band", "ord")


@query(
    "win_failure_streak", "log",
    """, numbered AS (SELECT source, ts, event_id, status <> 'success' AS failed, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS rn FROM log),
    streaks AS (SELECT *, CASE WHEN failed THEN rn - coalesce(max(CASE WHEN NOT failed THEN rn END) OVER
      (PARTITION BY source ORDER BY rn), 0) ELSE 0 END AS streak FROM numbered)
    SELECT event_id, source, streak, CASE WHEN max(streak) OVER (PARTITION BY source ORDER BY rn) >= 3 THEN 1 ELSE 0 END AS disabled FROM streaks""",
)
def _(t):
    log = t.log().select("source", "ts", "event_id", "status")
    return W.failure_streaks(log, ["source"], ["ts", "event_id"], F.col("status") != "success").select(
        "event_id", "source", "streak", "disabled"
    )


@query(
    "win_batch_number", "log",
    """SELECT event_id, endpoint, (row_number() OVER (PARTITION BY endpoint ORDER BY ts, event_id) - 1) // 100 AS batch_no FROM log""",
)
def _(t):
    log = t.log().select("endpoint", "ts", "event_id")
    return W.batch_numbers(log, ["endpoint"], ["ts", "event_id"], 100).select("event_id", "endpoint", "batch_no")


@query(
    "win_clamped_gauge", "log",
    """, steps AS (SELECT source, ts, event_id, CASE WHEN endpoint IN ('signup', 'view') THEN 1 WHEN endpoint IN ('click', 'purchase') THEN -1 ELSE 0 END AS step FROM log),
    sums AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY ts, event_id) AS s FROM steps)
    SELECT event_id, source, (s - least(0, min(s) OVER (PARTITION BY source ORDER BY ts, event_id)))::BIGINT AS gauge FROM sums""",
)
def _(t):
    step = F.when(F.col("endpoint").isin("signup", "view"), 1).when(F.col("endpoint").isin("click", "purchase"), -1).otherwise(0)
    log = t.log().select("source", "ts", "event_id", "endpoint")
    return W.clamped_gauge(log, ["source"], ["ts", "event_id"], step).select("event_id", "source", "gauge")


@query(
    "win_lru_retain", "log",
    """SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access FROM log GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 40""",
)
def _(t):
    return W.lru_retain(t.log(), "user_id", "ts", 40).select("user_id", iso("last_access").alias("last_access"))


@query(
    "win_backoff_schedule", "log",
    """, hits AS (SELECT event_id, source, ts, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS hit_no FROM log WHERE status = 'rate_limited')
    SELECT event_id, source, hit_no, least(15 * pow(2, least(hit_no - 1, 30)), 120)::BIGINT AS cooldown_minutes,
      strftime(ts + to_minutes(least(15 * pow(2, least(hit_no - 1, 30)), 120)::BIGINT), '%Y-%m-%d %H:%M:%S') AS cooldown_until FROM hits""",
)
def _(t):
    hits = t.log().filter(F.col("status") == "rate_limited").select("source", "ts", "event_id")
    return W.backoff_schedule(hits, ["source"], ["ts", "event_id"], "ts").select(
        "event_id", "source", "hit_no", "cooldown_minutes", iso("cooldown_until").alias("cooldown_until")
    )


# --- token buckets ------------------------------------------------------------------------------

#: Bucket sizes that deny a visible share of the sample log: (capacity, tokens per second).
ENDPOINT_LIMITS = {
    "click": (5.0, 5 / 14400), "view": (9.0, 9 / 14400), "purchase": (4.0, 4 / 7200), "signup": (3.0, 3 / 7200),
    "error": (6.0, 6 / 10800),
}
APP_LIMIT = (12.0, 12 / 43200)
INTERVAL = 60.0
MAX_WAIT = 3600.0


def _limit_column(i, limits_by_key=ENDPOINT_LIMITS):
    out = F.lit(None).cast("double")
    for key, pair in limits_by_key.items():
        out = F.when(F.col("endpoint") == key, F.lit(pair[i])).otherwise(out)
    return out


def _case(i):
    return "CASE endpoint " + " ".join(f"WHEN '{k}' THEN {v[i]!r}::DOUBLE" for k, v in ENDPOINT_LIMITS.items()) + " END"


_LIMITED = f""", lim AS (SELECT *, {_case(0)} AS cap, {_case(1)} * {INTERVAL} AS rate FROM log)"""


def bucket_sql(name, key, cap, rate, interval, max_wait=0.0, source="lim"):
    """A replay one request after the other: for every key, request rn + 1 follows request rn."""
    gap = f"(n.ts_us - w.last) / 1e6"
    level = (
        f"CASE WHEN {gap} >= {interval} THEN least(n.cap, w.tokens + {gap} / {interval} * n.rate) ELSE w.tokens END"
    )
    decide = lambda v: f"(1 - ({v}) <= 0 OR (1 - ({v})) / {{r}} * {interval} <= {max_wait})"
    return f""", {name}_n AS MATERIALIZED (SELECT {key} AS k, event_id, ts_us, {cap} AS cap, {rate} AS rate,
        row_number() OVER (PARTITION BY {key} ORDER BY ts_us, event_id) AS rn FROM {source}),
    {name}_w AS (
      SELECT k, rn, event_id, rate, cap AS before, ts_us AS last, {decide('cap').format(r='rate')} AS ok,
        CASE WHEN {decide('cap').format(r='rate')} THEN cap - 1 ELSE cap END AS tokens FROM {name}_n WHERE rn = 1
      UNION ALL
      SELECT k, rn, event_id, rate, v, last, {decide('v').format(r='rate')},
        CASE WHEN {decide('v').format(r='rate')} THEN v - 1 ELSE v END FROM (
          SELECT n.k, n.rn, n.event_id, n.rate, {level} AS v,
            CASE WHEN {gap} >= {interval} THEN n.ts_us ELSE w.last END AS last
          FROM {name}_w w JOIN {name}_n n ON n.k = w.k AND n.rn = w.rn + 1)),
    {name} AS (SELECT k, event_id, CASE WHEN ok THEN 1 ELSE 0 END AS allowed,
        CASE WHEN ok AND before < 1 THEN (1 - before) / rate * {interval} ELSE 0 END AS delay_s FROM {name}_w)"""


ENDPOINT_SQL = _LIMITED + bucket_sql("bucket", "endpoint", "cap", "rate", INTERVAL)
APP_SQL = bucket_sql("app", "source", f"{APP_LIMIT[0]}::DOUBLE", f"{APP_LIMIT[1] * INTERVAL!r}::DOUBLE", INTERVAL)
DELAY_SQL = _LIMITED + bucket_sql("bucket", "endpoint", "cap", "rate", INTERVAL, MAX_WAIT)

BUCKET_ORACLE = ENDPOINT_SQL + " SELECT event_id, k AS endpoint, allowed FROM bucket"
TWO_ORACLE = ENDPOINT_SQL + APP_SQL + """ SELECT event_id, b.k AS endpoint, a.k AS source, b.allowed AS endpoint_allowed,
  a.allowed AS app_allowed, b.allowed * a.allowed AS allowed FROM bucket b JOIN app a USING (event_id)"""
DELAY_ORACLE = DELAY_SQL + " SELECT event_id, k AS endpoint, allowed, round(delay_s, 3) AS delay_s FROM bucket"


def requests(t, *extra):
    return t.log().select("endpoint", "event_id", "ts_us", *extra)


@query("replay_token_bucket", "log", BUCKET_ORACLE)
def _(t):
    done = limits.replay(requests(t), ["endpoint"], "ts_us", "event_id", _limit_column(0), _limit_column(1) * INTERVAL, INTERVAL)
    return done.select("event_id", "endpoint", "allowed")


@query("replay_two_buckets", "log", TWO_ORACLE)
def _(t):
    app = (F.lit(APP_LIMIT[0]), F.lit(APP_LIMIT[1] * INTERVAL))
    done = limits.two_buckets(
        requests(t, "source"), ["endpoint"], ["source"], "ts_us", "event_id", (_limit_column(0), _limit_column(1) * INTERVAL), app, INTERVAL
    )
    return done.select("event_id", "endpoint", "source", "endpoint_allowed", "app_allowed", "allowed")


@query("replay_admission_delay", "log", DELAY_ORACLE)
def _(t):
    done = limits.replay(requests(t), ["endpoint"], "ts_us", "event_id", _limit_column(0), _limit_column(1) * INTERVAL, INTERVAL, MAX_WAIT)
    return done.select("event_id", "endpoint", "allowed", F.round("delay_s", 3).alias("delay_s"))


@query(
    "agg_limiter_stats", "log",
    DELAY_SQL + """ SELECT k AS endpoint, sum(allowed)::BIGINT AS requests_allowed, sum(1 - allowed)::BIGINT AS requests_denied,
      count(*) FILTER (allowed = 1 AND delay_s > 0) AS requests_waited, round(sum(delay_s * allowed), 2) AS total_wait_s,
      round(sum(1 - allowed)::DOUBLE / count(*), 6) AS denial_rate FROM bucket GROUP BY 1""",
)
def _(t):
    done = limits.replay(requests(t), ["endpoint"], "ts_us", "event_id", _limit_column(0), _limit_column(1) * INTERVAL, INTERVAL, MAX_WAIT)
    stats = G.limiter_stats(done, ["endpoint"])
    return stats.withColumns({"total_wait_s": F.round("total_wait_s", 2), "denial_rate": R6("denial_rate")})
