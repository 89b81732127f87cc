"""Calendar shards over posts."""

from pyspark.sql import functions as F

from postlake.functions import periods as P
from postlake.functions.marks import size_mb
from postlake.operators import shards as D
from postlake.plans.registry import query
from postlake.session import scratch_path

_DATED = "(regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2}T'))"
_Y, _M = "substr(created_at, 1, 4)", "CAST(substr(created_at, 6, 2) AS INTEGER)"
_HASH = "'fallback_S' || lpad((('0x' || md5(id))::UHUGEINT % {n} + 1)::VARCHAR, 2, '0')"


def _key(n):
    if n == 4:
        period = f"'_Q' || (({_M} - 1) // 3 + 1)"
    elif n == 12:
        period = f"'_' || lpad(({_M})::VARCHAR, 2, '0')"
    else:
        period = f"'_S' || lpad((({_M} - 1) * {n} // 12 + 1)::VARCHAR, 2, '0')"
    return f"CASE WHEN {_DATED} THEN {_Y} || {period} ELSE {_HASH.format(n=n)} END"


_SHARDED = f", sharded AS (SELECT *, {_key(4)} AS shard_key FROM tw) "


def _keys(name, n):
    @query(name, "tw", f"SELECT id, {_key(n)} AS shard_key FROM tw")
    def _(t):
        return D.with_shard(t.posts(), n).select("id", "shard_key")


_keys("fn_shard_key_quarter", 4)
_keys("fn_shard_key_month", 12)
_keys("fn_shard_key_custom", 6)


@query("fn_shard_key_fallback", "tw", f"SELECT id, {_HASH.format(n=7)} AS shard_key FROM tw")
def _(t):
    return t.posts().select("id", P.fallback_key("id", 7).alias("shard_key"))


@query(
    "fn_shards_in_range", "",
    """, spans AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list_transform(
      generate_series(date_trunc('month', a), b::TIMESTAMP, INTERVAL 1 MONTH),
      lambda m: year(m) || '_Q' || quarter(m)))), ',') AS shards FROM spans""",
)
def _(t):
    spans = t.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", F.array_join(P.shards_in_range("a", "b", 4), ",").alias("shards"))


def _table(t, columns=("id", "created_at", "username", "lang")):
    """The posts as a partitioned table in the shared folder."""
    path = scratch_path(t.spark, "shards")
    posts = D.with_shard(t.posts()).select(*columns, "shard_key")
    D.write_sharded(posts, path)
    return D.read_sharded(t.spark, path)


@query("src_shard_scan", "tw", _SHARDED + "SELECT id, created_at, shard_key FROM sharded WHERE shard_key = '2024_Q2'")
def _(t):
    return D.scan(_table(t), "2024_Q2").select("id", "created_at", "shard_key")


@query("sink_sharded_roundtrip", "tw", _SHARDED + "SELECT id, created_at, username, lang, shard_key FROM sharded")
def _(t):
    """Two overlapping batches: rows of the first that come again, with the same seq, are replaced; the others stay."""
    path = scratch_path(t.spark, "upserted-shards")
    posts = D.with_shard(t.posts()).select("id", "created_at", "username", "lang", F.lit(1).alias("seq"), "shard_key")
    number = F.col("id").cast("int")
    again = number % 3 == 0
    first = posts.filter(number % 2 == 0).withColumn("username", F.when(again, F.lit("stale")).otherwise(F.col("username")))
    D.upsert_sharded(first, path, "seq")
    D.upsert_sharded(posts.filter((number % 2 == 1) | again), path, "seq")
    return D.read_sharded(t.spark, path).drop("seq")



@query(
    "lookup_with_sentiment", "tw sa",
    _SHARDED + """SELECT id, created_at, sa.label, round(sa.compound, 6) AS compound FROM sharded LEFT JOIN sa ON id = tweet_id
      WHERE shard_key = '2024_Q1' AND id = '24'""",
)
def _(t):
    found = D.lookup_with_sentiment(_table(t), t.scores(), "2024_Q1", "24")
    return found.select("id", "created_at", "label", F.round("compound", 6).alias("compound"))


@query(
    "lookup_without_shard", "tw sa",
    _SHARDED + """SELECT id, created_at, shard_key, sa.label, round(sa.compound, 6) AS compound FROM sharded LEFT JOIN sa ON id = tweet_id
      WHERE id = '57'""",
)
def _(t):
    """The same without a shard: the id's Bloom filters leave few row groups of the whole table."""
    found = D.lookup_with_sentiment(_table(t), t.scores(), None, "57")
    return found.select("id", "created_at", "shard_key", "label", F.round("compound", 6).alias("compound"))


@query(
    "agg_shard_summary", "tw",
    _SHARDED + "SELECT shard_key, count(*) AS n, min(created_at) AS min_date, max(created_at) AS max_date FROM sharded GROUP BY 1",
)
def _(t):
    return D.summary(D.with_shard(t.posts()))


@query("agg_lang_distribution", "tw", _SHARDED + "SELECT shard_key, lang, count(*) AS n FROM sharded GROUP BY 1, 2")
def _(t):
    return D.languages(D.with_shard(t.posts()))


@query(
    "agg_label_distribution", "tw sa",
    _SHARDED + "SELECT shard_key, label, count(*) AS n FROM sharded JOIN sa ON id = tweet_id GROUP BY 1, 2",
)
def _(t):
    return D.labels(D.with_shard(t.posts()), t.scores())


@query(
    "rollup_shard_totals", "tw",
    _SHARDED + """SELECT coalesce(shard_key, '(all)') AS shard_key, grouping(shard_key)::INTEGER AS is_total, count(*) AS n
      FROM sharded GROUP BY ROLLUP (shard_key)""",
)
def _(t):
    return D.totals(D.with_shard(t.posts()))


@query("agg_shard_placement", "tw", f"SELECT {_key(12)} AS shard_key, count(*) AS n FROM tw GROUP BY 1")
def _(t):
    return D.placement(t.posts(), 12)


@query(
    "topk_per_shard", "tw",
    _SHARDED + """SELECT shard_key, id, retweet_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY shard_key
      ORDER BY retweet_count DESC, id) AS rank FROM sharded) WHERE rank <= 5""",
)
def _(t):
    top = D.top_per_shard(D.with_shard(t.posts()), 5, F.desc("retweet_count"), F.asc("id"))
    return top.select("shard_key", "id", "retweet_count", F.col("rank").cast("bigint").alias("rank"))


@query("union_all_shards", "tw", _SHARDED + "SELECT id, username, shard_key FROM sharded WHERE username = 'user_1'")
def _(t):
    # Two scans of disjoint folders of the partitioned table.
    table = _table(t)
    dated = table.filter(~F.col("shard_key").startswith("fallback"))
    others = table.filter(F.col("shard_key").startswith("fallback"))
    return D.union_shards(dated, others).filter(F.col("username") == "user_1").select("id", "username", "shard_key")


@query(
    "union_shards_in_range", "tw",
    _SHARDED + "SELECT id, created_at, shard_key FROM sharded WHERE shard_key IN ('2024_Q1', '2024_Q2', '2024_Q3')",
)
def _(t):
    return D.scan_range(_table(t), "2024-02-15", "2024-07-31").select("id", "created_at", "shard_key")


@query(
    "fn_size_mb", "tw",
    _SHARDED + """SELECT shard_key, sum(octet_length(encode(text)))::BIGINT AS n_bytes,
      round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE, 2) AS size_mb FROM sharded GROUP BY 1""",
)
def _(t):
    size = D.with_shard(t.posts()).groupBy("shard_key").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    return size.withColumn("size_mb", size_mb("n_bytes"))


