"""Stored-table queries: selection, joins, counts, upserts."""

from pyspark.sql import functions as F

from postlake.functions.marks import result_key, label_from_compound, label_from_polarity, TTL_SEARCH, TTL_USER, OUTER_TIER_CAP, expires_at
from postlake.operators import joins as J, search as Q, store as S
from postlake.plans.fixtures import iso, now
from postlake.plans.registry import query
from postlake.sources.ingest import sql_with_params

R6 = lambda c: F.round(c, 6)


@query("proj_columns", "tw", "SELECT id, username, lang FROM tw")
def _(t):
    return S.project(t.posts(), "id", "username", "lang")


@query("filter_and", "tw", "SELECT id, retweet_count, lang FROM tw WHERE lang = 'en' AND retweet_count >= 10 AND favorite_count < 80")
def _(t):
    hit = S.where_all(t.posts(), F.col("lang") == "en", F.col("retweet_count") >= 10, F.col("favorite_count") < 80)
    return hit.select("id", "retweet_count", "lang")


@query("filter_in", "tw", "SELECT id, username FROM tw WHERE username IN ('user_1', 'user_42', 'user_99')")
def _(t):
    return S.where_in(t.posts(), "username", ["user_1", "user_42", "user_99"]).select("id", "username")


@query("filter_optional_eq", "tw", "SELECT id, query FROM tw WHERE query = 'src3'")
def _(t):
    return S.where_equal(S.where_equal(t.posts(), "query", "src3"), "lang", None).select("id", "query")


_NEWEST = "ORDER BY created_at DESC NULLS LAST, id ASC"
_LIKE = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%tion%'"
_HIT = f"({_LIKE.format(c='text')} OR {_LIKE.format(c='original_text')})"


@query("search_text", "tw", f"SELECT id, created_at FROM tw WHERE {_HIT} {_NEWEST} LIMIT 100")
def _(t):
    return Q.search_text(t.posts(), "TION", 100).select("id", "created_at")


@query(
    "filter_date_range", "tw",
    f"SELECT id, created_at FROM tw WHERE created_at BETWEEN '2024-02-01' AND '2024-09-30T23:59:59' {_NEWEST} LIMIT 1000",
)
def _(t):
    return S.between_dates(t.posts(), "2024-02-01", "2024-09-30T23:59:59").select("id", "created_at")


@query("lookup_by_id", "tw", "SELECT id, text, username FROM tw WHERE id = '42'")
def _(t):
    return t.posts().filter(F.col("id") == "42").select("id", "text", "username")


@query("posts_by_query", "tw", f"SELECT id, query, created_at FROM tw WHERE query = 'src5' {_NEWEST} LIMIT 25")
def _(t):
    return Q.newest(S.where_equal(t.posts(), "query", "src5"), 25).select("id", "query", "created_at")


_JOINED = """SELECT {cols} FROM tw LEFT JOIN sa ON tw.id = sa.tweet_id"""


@query(
    "proj_nest_sentiment", "tw sa",
    """SELECT id, CASE WHEN label IS NOT NULL THEN '{"label":"' || label || '","compound":' || CAST(round(compound * 100) AS BIGINT)
      || CASE WHEN polarity IS NOT NULL THEN ',"has_polarity":true' ELSE '' END || '}' END AS sentiment
      FROM tw LEFT JOIN sa ON tw.id = sa.tweet_id""",
)
def _(t):
    nested = S.nest_sentiment(J.posts_with_scores(t.posts().select("id"), t.scores()))
    s = F.col("sentiment")
    shown = F.struct(
        s["label"].alias("label"), F.round(s["compound"] * 100).cast("bigint").alias("compound"),
        F.when(s["polarity"].isNotNull(), True).alias("has_polarity"),
    )
    return nested.select("id", F.when(s.isNotNull(), F.to_json(shown)).alias("sentiment"))


@query(
    "proj_flatten_sentiment", "sa",
    """SELECT tweet_id, label AS sentiment_label, round(compound, 6) AS sentiment_compound, method AS sentiment_method FROM sa""",
)
def _(t):
    nested = t.scores().select("tweet_id", "method", F.struct("label", R6(F.col("compound")).alias("compound")).alias("s"))
    return nested.select(
        "tweet_id", F.col("s.label").alias("sentiment_label"), F.col("s.compound").alias("sentiment_compound"),
        F.col("method").alias("sentiment_method"),
    )


@query(
    "proj_cleaned_flag", "tw",
    "SELECT id, CASE WHEN coalesce(original_text, '') <> '' THEN 1 ELSE 0 END AS cleaned_text, coalesce(view_count, 0) AS view_count FROM tw",
)
def _(t):
    return S.normalized(t.posts()).select("id", "cleaned_text", "view_count")


@query(
    "join_posts_sentiment", "tw sa",
    _JOINED.format(cols="id, created_at, label AS sentiment_label, round(compound, 6) AS sentiment_compound")
    + f" WHERE query IN ('src1', 'src2') {_NEWEST} LIMIT 50 OFFSET 5",
)
def _(t):
    posts = S.where_in(t.posts(), "query", ["src1", "src2"]).select("id", "created_at")
    joined = J.posts_with_scores(posts, t.scores())
    return Q.newest(joined, 50, 5).select("id", "created_at", "sentiment_label", R6(F.col("sentiment_compound")).alias("sentiment_compound"))


@query(
    "search_text_with_sentiment", "tw sa",
    _JOINED.format(cols="id, label AS sentiment_label") + f" WHERE {_HIT} {_NEWEST} LIMIT 100",
)
def _(t):
    # The limit only depends on the posts, so it is taken before the join.
    hits = Q.search_text(t.posts(), "TION", 100).select("id")
    return J.posts_with_scores(hits, t.scores()).select("id", "sentiment_label")


@query("join_inner_scored", "tw sa", "SELECT id, lang, label AS sentiment_label FROM sa JOIN tw ON sa.tweet_id = tw.id")
def _(t):
    return J.posts_with_scores(t.posts().select("id", "lang"), t.scores(), "inner").select("id", "lang", "sentiment_label")


@query(
    "anti_orphans", "tw sa",
    "SELECT tweet_id, label FROM sa WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.id = sa.tweet_id)",
)
def _(t):
    return J.orphans(t.scores(), t.posts(), "tweet_id", "id").select("tweet_id", "label")


@query(
    "semi_cascade", "tw sa",
    """, gone AS (SELECT id FROM tw WHERE lang = 'de')
    SELECT tweet_id, CASE WHEN tweet_id IN (SELECT id FROM gone) THEN 1 ELSE 0 END AS deleted FROM sa""",
)
def _(t):
    gone = t.posts().filter(F.col("lang") == "de").select("id")
    kept, dropped = J.cascade_delete(t.scores().select("tweet_id"), gone, "tweet_id", "id")
    return kept.withColumn("deleted", F.lit(0)).unionByName(dropped.withColumn("deleted", F.lit(1)))


def _entries(t, ttl_default, cap=None):
    """The cache as it stands: the last set of every key."""
    sets = t.cache_sets().withColumn("expires_at", expires_at("created_at", "ttl", ttl_default, cap))
    return S.keep_last(sets, ["key"], [F.desc("created_at"), F.desc("event_id")]).select("key", F.col("event_id").alias("value"), "expires_at")


_ENTRIES = """, {name} AS (SELECT key, event_id AS value, created_at + to_seconds({ttl}) AS expires_at FROM cache_sets
   {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1)"""


@query(
    "lookup_two_tier", "cache_sets log",
    _ENTRIES.format(name="l1", ttl="coalesce(nullif(ttl, 0), 600)", where="")
    + _ENTRIES.format(name="l2", ttl="least(coalesce(nullif(ttl, 0), 1209600), 1209600)", where="WHERE ttl IS NOT NULL")
    + """ SELECT event_id, coalesce(l1.value, l2.value) AS value,
       CASE WHEN l1.key IS NOT NULL THEN 'L1' WHEN l2.key IS NOT NULL THEN 'L2' ELSE 'miss' END AS tier
     FROM log LEFT JOIN l1 ON l1.key = log.user_id::VARCHAR AND TIMESTAMP '2024-01-15 00:00:00' < l1.expires_at
     LEFT JOIN l2 ON l2.key = log.user_id::VARCHAR AND TIMESTAMP '2024-01-15 00:00:00' <= l2.expires_at""",
)
def _(t):
    requests = t.log().select("event_id", F.col("user_id").cast("string").alias("key"))
    inner = _entries(t, TTL_USER)
    sets = t.cache_sets().filter(F.col("ttl").isNotNull())
    sets = sets.withColumn("expires_at", expires_at("created_at", "ttl", 1209600, 1209600))
    outer = S.keep_last(sets, ["key"], [F.desc("created_at"), F.desc("event_id")]).select("key", F.col("event_id").alias("value"), "expires_at")
    return J.two_tier_lookup(requests, inner, outer, "key", now(), ["event_id"]).select("event_id", "value", "tier")


@query(
    "reuse_search_result", "tw",
    """, stored AS (SELECT query, retweet_count % 5 AS n, max(favorite_count) AS result,
        TIMESTAMP '2024-01-15 00:00:00' + to_seconds((max(favorite_count) - 97) * 1800) AS expires_at
      FROM tw GROUP BY 1, 2)
    SELECT tw.id, stored.result, CASE WHEN stored.result IS NOT NULL THEN 1 ELSE 0 END AS reused
    FROM tw LEFT JOIN stored ON stored.query = tw.query AND stored.n = tw.favorite_count % 5
      AND TIMESTAMP '2024-01-15 00:00:00' <= stored.expires_at""",
)
def _(t):
    posts = t.posts()
    stored = posts.groupBy("query", (F.col("retweet_count") % 5).alias("n")).agg(F.max("favorite_count").alias("value"))
    age = F.make_dt_interval(secs=((F.col("value") - 97) * TTL_SEARCH).cast("decimal(18,6)"))
    stored = stored.select(result_key("search", "query", "n", F.lit("Top")).alias("result_key"), "value", (now() + age).alias("expires_at"))
    requests = posts.select("id", result_key("search", "query", F.col("favorite_count") % 5, F.lit("Top")).alias("result_key"))
    return J.reuse_results(requests, stored, now(), ["id"]).select("id", "result", "reused")


@query("agg_post_count", "tw", "SELECT count(*) AS n FROM tw WHERE query = 'src2'")
def _(t):
    return S.count_rows(S.where_equal(t.posts(), "query", "src2"))


_STATS = "count(*) AS {n}, round(avg(compound), 6) AS avg_compound, round(avg(polarity), 6) AS avg_polarity"


@query("agg_sentiment_stats", "tw sa", f"SELECT label, {_STATS.format(n='n')} FROM sa JOIN tw ON sa.tweet_id = tw.id GROUP BY label")
def _(t):
    stats = S.sentiment_stats(t.scores(), t.posts())
    return stats.select("label", "n", R6("avg_compound").alias("avg_compound"), R6("avg_polarity").alias("avg_polarity"))


@query(
    "agg_sentiment_overall", "tw sa",
    f"SELECT {_STATS.format(n='total')} FROM sa JOIN tw ON sa.tweet_id = tw.id WHERE query = 'src1'",
)
def _(t):
    stats = S.sentiment_overall(t.scores(), t.posts(), "src1")
    return stats.select("total", R6("avg_compound").alias("avg_compound"), R6("avg_polarity").alias("avg_polarity"))


@query("sort_multi", "tw", "SELECT id, lang, retweet_count FROM tw ORDER BY lang ASC NULLS FIRST, retweet_count DESC NULLS LAST, id")
def _(t):
    return S.page(t.posts().select("id", "lang", "retweet_count"), F.asc("lang"), F.desc("retweet_count"), F.asc("id"))


@query("page_limit_offset", "tw", f"SELECT id, created_at FROM tw {_NEWEST} LIMIT 30 OFFSET 60")
def _(t):
    return Q.newest(t.posts().select("id", "created_at"), 30, 60)


@query("product_latest", "tw", f"SELECT id, created_at FROM tw {_NEWEST} LIMIT 20")
def _(t):
    return Q.results(t.posts(), "Latest", 20).select("id", "created_at")


@query(
    "product_top", "tw",
    """SELECT id, retweet_count + favorite_count + coalesce(reply_count, 0) + coalesce(quote_count, 0) AS engagement
      FROM tw ORDER BY engagement DESC, id ASC LIMIT 20""",
)
def _(t):
    return Q.results(t.posts(), "Top", 20).select("id", "engagement")


@query(
    "upsert_keep_last", "tw",
    """, writes AS (SELECT id, 'old ' || username AS username, lang, view_count, 0 AS seq FROM tw
      UNION ALL SELECT id, username, lang, NULL, 1 + retweet_count FROM tw WHERE favorite_count < 30
      UNION ALL SELECT 'new_' || id, username, lang, NULL, 1 FROM tw WHERE favorite_count = 7)
    SELECT id, username, lang, coalesce(view_count, 0) AS view_count, seq FROM writes
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
)
def _(t):
    posts = t.posts()
    zero = F.lit(0).cast("bigint")
    current = posts.select("id", F.concat(F.lit("old "), "username").alias("username"), "lang", "view_count", zero.alias("seq"))
    changed = posts.filter(F.col("favorite_count") < 30).select("id", "username", "lang", (F.col("retweet_count") + 1).alias("seq"))
    added = posts.filter(F.col("favorite_count") == 7).select(
        F.concat(F.lit("new_"), "id").alias("id"), "username", "lang", F.lit(1).cast("bigint").alias("seq")
    )
    return S.upsert(current, changed.unionByName(added), ["id"], "seq")


@query(
    "src_sql_params", "tw sa",
    "SELECT lang, count(*) AS n, sum(retweet_count)::BIGINT AS retweets FROM tw WHERE retweet_count >= 25 AND username <> 'user_3' GROUP BY lang",
)
def _(t):
    return sql_with_params(
        t.spark, {"posts": t.posts(), "scores": t.scores()},
        "SELECT lang, count(*) AS n, sum(retweet_count) AS retweets FROM posts WHERE retweet_count >= ? AND username <> ? GROUP BY lang",
        [25, "user_3"],
    )


@query(
    "fn_label_compound", "sa",
    """SELECT tweet_id, CASE WHEN round(compound, 2) >= 0.05 THEN 'positive' WHEN round(compound, 2) <= -0.05 THEN 'negative'
      ELSE 'neutral' END AS label FROM sa""",
)
def _(t):
    return t.scores().select("tweet_id", label_from_compound(F.round("compound", 2)).alias("label"))


@query(
    "fn_label_polarity", "sa",
    "SELECT tweet_id, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END AS label FROM sa",
)
def _(t):
    return t.scores().select("tweet_id", label_from_polarity("polarity").alias("label"))


@query(
    "fn_ttl_expiry", "cache_sets",
    """SELECT event_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at,
      strftime(created_at + to_seconds(least(coalesce(nullif(ttl, 0), 86400), 3600)), '%Y-%m-%d %H:%M:%S') AS outer_expires_at
      FROM cache_sets""",
)
def _(t):
    outer = expires_at("created_at", "ttl", 86400, OUTER_TIER_CAP)
    return t.cache_sets().select("event_id", iso("expires_at").alias("expires_at"), iso(outer).alias("outer_expires_at"))


__all__: list[str] = []
