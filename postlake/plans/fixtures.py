"""Posts, scores, request logs and cache tables derived from the given tables.

Every view exists twice: as a DataFrame here and as SQL text for the oracle below. Both derive
row by row, so a query reads only the columns it needs of the underlying table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.marks import TTL_SEARCH, expires_at
from postlake.functions.text import Col
from postlake.session import pin_utc, spread

#: "Now" of every expiry rule; never the wall clock.
NOW = "2024-01-15 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def posts(self, source: DataFrame | None = None) -> DataFrame:
        return posts_from(self.raw("documents") if source is None else source)

    def texts(self) -> DataFrame:
        """Posts for heavy text work, dealt out when the table is small."""
        columns = ("doc_id", "text", "lang", "source")
        return posts_from(spread(self.raw("documents").select(*columns)))

    def scores(self) -> DataFrame:
        return scores_from(self.raw("labels"))

    def log(self, source: DataFrame | None = None) -> DataFrame:
        return log_from(self.raw("events") if source is None else source)

    def cache_sets(self) -> DataFrame:
        """One row per set operation: which key, when, and until when it lives."""
        e = self.raw("events")
        ttl = (
            F.when(F.col("event_type") == "click", 600).when(F.col("event_type") == "view", 1800)
            .when(F.col("event_type") == "purchase", 86400).when(F.col("event_type") == "signup", 0)
        )
        at = F.col("ts").cast("timestamp")
        return e.select(
            F.col("user_id").cast("string").alias("key"), "event_id", at.alias("created_at"), ttl.alias("ttl"),
            F.col("value").alias("value"),
        ).withColumn("expires_at", expires_at("created_at", "ttl", TTL_SEARCH))

    def statuses(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_type").alias("component"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
            F.least(F.col("value"), F.lit(100.0)).alias("usage"),
        )

    def search_pages(self) -> DataFrame:
        """Twenty posts per page in id order; every seventh post shows up again on the next page."""
        d = self.raw("documents").select("doc_id")
        page, pos = F.floor(F.col("doc_id") / 20).cast("bigint"), (F.col("doc_id") % 20).cast("bigint")
        first = F.struct(page.alias("page"), pos.alias("pos"))
        again = F.struct((page + 1).alias("page"), (pos + 20).alias("pos"))
        copies = F.when(F.col("doc_id") % 7 == 0, F.array(first, again)).otherwise(F.array(first))
        spread = d.select(F.col("doc_id").cast("string").alias("id"), F.explode(copies).alias("_c"))
        return spread.select("id", "_c.page", "_c.pos")

    def payloads(self) -> DataFrame:
        d = self.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("payload"))
        p = self.raw("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("payload"))
        return d.unionByName(p)


def posts_from(documents: DataFrame) -> DataFrame:
    n = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + (n % 30000) * F.lit(28800))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    sparse = lambda c: F.when(n % 5 != 0, c)
    created = (
        F.when(n % 37 == 0, "").when(n % 41 == 0, "not a date").when(n % 43 == 0, F.concat(iso, F.lit("+09:00"))).otherwise(iso)
    )
    return documents.select(
        n.cast("string").alias("id"),
        F.concat(
            F.col("text"), F.lit(" #"), F.col("lang"), F.lit(" @"), F.col("source"),
            F.lit(" https://example.com/d?i="), n.cast("string"),
        ).alias("text"),
        F.when(n % 2 == 0, F.col("text")).alias("original_text"),
        created.alias("created_at"),
        F.concat(F.lit("User "), (n % 100).cast("string")).alias("user_name"),
        F.concat(F.lit("user_"), (n % 100).cast("string")).alias("username"),
        (n % 50).alias("retweet_count"),
        (n % 100).alias("favorite_count"),
        sparse(n % 1000).alias("view_count"),
        sparse(n % 7).alias("reply_count"),
        sparse(n % 11).alias("quote_count"),
        F.col("lang").alias("lang"),
        F.col("source").alias("query"),
    )


def scores_from(labels: DataFrame) -> DataFrame:
    n, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    # Every twentieth score is repeated for a post that does not exist.
    ids = F.when(n % 20 == 0, F.array(n.cast("string"), F.concat(F.lit("gone_"), n.cast("string")))).otherwise(
        F.array(n.cast("string"))
    )
    return labels.select(
        F.explode(ids).alias("tweet_id"),
        F.lit("vader").alias("method"),
        F.when(t == 1, "negative").when(q == 1, "positive").otherwise("neutral").alias("label"),
        ((q - t) * F.lit(0.5) + (n % 7) / F.lit(100.0)).alias("compound"),
        (q * F.lit(0.25)).alias("positive"),
        (t * F.lit(0.25)).alias("negative"),
        F.lit(0.5).alias("neutral"),
        F.when(n % 2 == 1, (q - t) * F.lit(0.3)).alias("polarity"),
        F.when(n % 2 == 1, F.lit(0.4)).alias("subjectivity"),
    )


def log_from(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 150, "rate_limited").otherwise("success")
    )
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "event_id", ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), F.col("event_type").alias("endpoint"),
        status.alias("status"), (F.col("value") / 1000).alias("response_time"),
        F.concat(F.lit("acct_"), (F.col("user_id") % 10).cast("string")).alias("source"),
        F.col("user_id").alias("user_id"),
    )


def iso(c: Col) -> Column:
    """Timestamps leave a query as text, so both sides print them alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- the same views as SQL text -------------------------------------------------------------

_ISO = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 30000) * 8), '%Y-%m-%dT%H:%M:%S')"

TW = f"""tw AS (SELECT CAST(doc_id AS VARCHAR) AS id,
  text || ' #' || lang || ' @' || source || ' https://example.com/d?i=' || doc_id AS text,
  CASE WHEN doc_id % 2 = 0 THEN text END AS original_text,
  CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 41 = 0 THEN 'not a date'
       WHEN doc_id % 43 = 0 THEN {_ISO} || '+09:00' ELSE {_ISO} END AS created_at,
  'User ' || doc_id % 100 AS user_name, 'user_' || doc_id % 100 AS username,
  doc_id % 50 AS retweet_count, doc_id % 100 AS favorite_count,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 1000 END AS view_count,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END AS reply_count,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 END AS quote_count,
  lang, source AS query, doc_id FROM documents)"""

SA = """sa AS (SELECT unnest(CASE WHEN doc_id % 20 = 0 THEN [CAST(doc_id AS VARCHAR), 'gone_' || doc_id]
         ELSE [CAST(doc_id AS VARCHAR)] END) AS tweet_id, 'vader' AS method,
  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
  (quality - toxic) * 0.5::DOUBLE + (doc_id % 7) / 100.0::DOUBLE AS compound,
  quality * 0.25::DOUBLE AS positive, toxic * 0.25::DOUBLE AS negative, 0.5::DOUBLE AS neutral,
  CASE WHEN doc_id % 2 = 1 THEN (quality - toxic) * 0.3::DOUBLE END AS polarity,
  CASE WHEN doc_id % 2 = 1 THEN 0.4::DOUBLE END AS subjectivity FROM labels)"""

LOG = """log AS (SELECT event_id, ts, epoch_us(ts) AS ts_us, event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value > 150 THEN 'rate_limited' ELSE 'success' END AS status,
  value / 1000 AS response_time, 'acct_' || user_id % 10 AS source, user_id FROM events)"""

CACHE = """cache_sets AS (SELECT *, created_at + to_seconds(coalesce(nullif(ttl, 0), 1800)) AS expires_at FROM (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts AS created_at, CASE event_type WHEN 'click' THEN 600
    WHEN 'view' THEN 1800 WHEN 'purchase' THEN 86400 WHEN 'signup' THEN 0 END AS ttl, value FROM events))"""

STATUS = """statuses AS (SELECT event_type AS component, event_id, ts, least(value, 100.0) AS usage FROM events)"""

PAGES = """search_pages AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id // 20 AS page, doc_id % 20 AS pos FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id // 20 + 1, doc_id % 20 + 20 FROM documents WHERE doc_id % 7 = 0)"""

PAYLOADS = """payloads AS (SELECT 'd' || doc_id AS id, text AS payload FROM documents
  UNION ALL SELECT 'p' || page_id, html FROM pages)"""

ORACLE_VIEWS = {
    "tw": TW, "sa": SA, "log": LOG, "cache_sets": CACHE, "statuses": STATUS, "search_pages": PAGES, "payloads": PAYLOADS,
}


def with_views(sql: str, *views: str) -> str:
    parts = [ORACLE_VIEWS[v] for v in views]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql if parts else sql
