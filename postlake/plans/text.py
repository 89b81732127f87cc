"""Text functions over posts."""

from pyspark.sql import functions as F

from postlake.functions import text as X
from postlake.functions.marks import result_key
from postlake.functions.register import register
from postlake.operators.store import post_metadata
from postlake.plans.fixtures import now
from postlake.plans.registry import query

SPACES, LINK, TAG, MENTION, URL = X.SPACES, X.LINK_RUN, X.HASHTAG, X.MENTION, X.URL

CLEAN_SQL = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{LINK}', '', 'g'), "
    f"'{MENTION}', '', 'g'), '{TAG}', '', 'g'), '{SPACES}', ' ', 'g'))"
)


@query("fn_clean_text", "tw", f"SELECT id, {CLEAN_SQL} AS cleaned FROM tw")
def _(t):
    return t.texts().select("id", X.clean_text("text").alias("cleaned"))


def _joined(c):
    return F.array_join(c, "|")


@query("fn_hashtags", "tw", f"SELECT id, array_to_string(regexp_extract_all(text, '{TAG}'), '|') AS hashtags FROM tw")
def _(t):
    return t.posts().select("id", _joined(X.hashtags("text")).alias("hashtags"))


@query("fn_mentions", "tw", f"SELECT id, array_to_string(regexp_extract_all(text, '{MENTION}'), '|') AS mentions FROM tw")
def _(t):
    return t.posts().select("id", _joined(X.mentions("text")).alias("mentions"))


@query("fn_urls", "tw", f"SELECT id, array_to_string(regexp_extract_all(text, '{URL}'), '|') AS urls FROM tw")
def _(t):
    return t.posts().select("id", _joined(X.urls("text")).alias("urls"))


@query(
    "explode_metadata", "tw",
    f"""SELECT id AS tweet_id, m.metadata_type, m.value FROM (SELECT id, unnest(
      list_transform(regexp_extract_all(text, '{TAG}'), lambda x: {{'metadata_type': 'hashtag', 'value': x}})
      || list_transform(regexp_extract_all(text, '{MENTION}'), lambda x: {{'metadata_type': 'mention', 'value': x}})
      || list_transform(regexp_extract_all(text, '{URL}'), lambda x: {{'metadata_type': 'url', 'value': x}})) AS m FROM tw)""",
)
def _(t):
    return post_metadata(t.texts(), source=F.col("text"))


@query(
    "fn_safe_name", "tw",
    r"SELECT id, substring(regexp_replace(user_name || '/' || query || '!', '[^\p{L}\p{N}]', '_', 'g'), 1, 30) AS name FROM tw",
)
def _(t):
    label = F.concat("user_name", F.lit("/"), "query", F.lit("!"))
    return t.posts().select("id", X.safe_name(label).alias("name"))


@query(
    "fn_output_name", "tw",
    r"""SELECT query, count(*) AS n, 'tweets_' || substring(regexp_replace(query, '[^\p{L}\p{N}]', '_', 'g'), 1, 30)
      || '_20240115_000000.csv' AS file_name FROM tw GROUP BY query""",
)
def _(t):
    per_query = t.posts().groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return per_query.select("query", "n", X.output_name("query", now(), "csv").alias("file_name"))


_VERBS = {"click": "select", "view": "INSERT INTO", "purchase": "Update", "signup": "delete from"}
_VERB_SQL = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VERBS.items()) + " ELSE 'PRAGMA' END"


@query(
    "fn_query_type", "log",
    f""", s AS (SELECT event_id, repeat(' ', (event_id % 3)::INTEGER) || {_VERB_SQL} || ' ' || source || ' ' || status || ' ' || event_id AS statement FROM log)
    SELECT event_id, statement, CASE WHEN regexp_matches(upper(ltrim(statement)), '^(SELECT|INSERT|UPDATE|DELETE)')
      THEN regexp_extract(upper(ltrim(statement)), '^[A-Z]+') ELSE 'OTHER' END AS query_type FROM s""",
)
def _(t):
    verb = F.lit("PRAGMA")
    for endpoint, text in _VERBS.items():
        verb = F.when(F.col("endpoint") == endpoint, text).otherwise(verb)
    blanks = F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int"))
    statement = F.concat(blanks, F.concat_ws(" ", verb, "source", "status", F.col("event_id").cast("string")))
    return t.log().select("event_id", statement.alias("statement")).withColumn("query_type", X.query_type("statement"))


@query(
    "fn_rule_label", "tw",
    """SELECT id, CASE WHEN contains(text, 'great') OR contains(text, 'love') OR contains(text, 'excellent') THEN 'positive'
      WHEN contains(text, 'terrible') OR contains(text, 'poor') OR contains(text, 'waste') THEN 'negative'
      ELSE 'neutral' END AS rule_label FROM tw""",
)
def _(t):
    return t.posts().select("id", X.rule_label("text").alias("rule_label"))


@query(
    "fn_result_key", "tw",
    """SELECT id, md5('6:search:' || coalesce(length(query) || ':' || query, '-') || ':' || length(retweet_count::VARCHAR) || ':' || retweet_count
      || ':' || coalesce(length(view_count::VARCHAR) || ':' || view_count, '-')) AS result_key FROM tw""",
)
def _(t):
    return t.posts().select("id", result_key("search", "query", "retweet_count", "view_count").alias("result_key"))


@query(
    "sql_post_functions", "tw",
    f"""SELECT id, {CLEAN_SQL} AS cleaned, array_to_string(regexp_extract_all(text, '{TAG}'), '|') AS hashtags,
      array_to_string(regexp_extract_all(text, '{MENTION}'), '|') AS mentions,
      CASE WHEN retweet_count > 25 THEN 'positive' WHEN retweet_count < 25 THEN 'negative' ELSE 'neutral' END AS label,
      CASE WHEN view_count IS NULL THEN 'unknown' WHEN view_count > 90 THEN 'unhealthy' WHEN view_count > 80 THEN 'degraded' ELSE 'healthy' END AS band
      FROM tw""",
)
def _(t):
    """The functions by their SQL names, in SQL."""
    register(t.spark)
    return t.spark.sql(
        """SELECT id, post_clean(text) AS cleaned, array_join(post_hashtags(text), '|') AS hashtags,
          array_join(post_mentions(text), '|') AS mentions, label_polarity(retweet_count - 25.0D) AS label,
          threshold_band(CAST(view_count AS DOUBLE)) AS band FROM {posts}""",
        posts=t.texts(),
    )


@query(
    "fn_json_fields", "",
    """SELECT event_id, event_type AS endpoint, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      '{"event_id":' || event_id || ',"endpoint":"' || event_type || '"}' AS as_json FROM events""",
)
def _(t):
    fields = F.from_json("props", "k bigint")
    row = F.struct("event_id", F.col("event_type").alias("endpoint"))
    return t.raw("events").select("event_id", F.col("event_type").alias("endpoint"), fields["k"].alias("k"), F.to_json(row).alias("as_json"))
