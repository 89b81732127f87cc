"""Sources and sinks. A sink query writes the whole table to the shared folder and reads it back."""

from pyspark.sql import functions as F, types as T

from postlake.functions import packing as K
from postlake.plans.fixtures import now
from postlake.plans.registry import query
from postlake.schema import COUNTERS
from postlake.session import scratch_path
from postlake.sources import export as E, ingest as I

ROW = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("original_text", T.StringType()),
    T.StructField("username", T.StringType()), T.StructField("retweet_count", T.LongType()), T.StructField("view_count", T.LongType()),
])
_ROW_SQL = "SELECT id, text, original_text, username, retweet_count, view_count FROM tw"
_QUOTED = "'say \"' || username || '\", ok'"
_ROW_CSV_SQL = f"SELECT id, text, original_text, {_QUOTED} AS username, retweet_count, view_count FROM tw"


def _rows(t):
    return t.posts().select(*ROW.names)


def _dealt_rows(t):
    """The rows of a file of one row group are not left to one task where each passes through Python."""
    return t.texts().select(*ROW.names)


def _quoted_rows(t):
    quoted = F.concat(F.lit('say "'), "username", F.lit('", ok'))
    return _rows(t).withColumn("username", quoted)


def _typed(df):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROW.fields])


@query("src_flatten_posts", "tw", """SELECT id, text, created_at, user_name AS user, username, retweet_count, favorite_count,
      coalesce(view_count, 0) AS view_count, coalesce(reply_count, 0) AS reply_count, coalesce(quote_count, 0) AS quote_count, lang FROM tw""")
def _(t):
    user = F.struct(F.col("user_name").alias("name"), F.col("username").alias("screen_name")).alias("user")
    return I.flatten(t.posts().select("id", "text", "created_at", "lang", *COUNTERS, user))


@query(
    "src_paged_ingest", "search_pages",
    """SELECT id, page, pos FROM search_pages QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, pos) = 1
      ORDER BY page, pos LIMIT 150""",
)
def _(t):
    return I.paged(t.search_pages(), 150).select("id", "page", "pos")


@query("src_json_array", "tw", _ROW_SQL)
def _(t):
    path = scratch_path(t.spark, "json-array")
    E.write_json_array(_dealt_rows(t), path)
    return I.read_json_array(t.spark, path, ROW)


@query("sink_json_array_roundtrip", "tw", _ROW_SQL)
def _(t):
    path = scratch_path(t.spark, "json-pretty")
    E.write_json_array(_dealt_rows(t), path, pretty=True)
    return I.read_json_array(t.spark, path, ROW)


@query("src_csv", "tw", _ROW_CSV_SQL.replace("retweet_count, view_count", "retweet_count::VARCHAR AS retweet_count, view_count::VARCHAR AS view_count"))
def _(t):
    path = scratch_path(t.spark, "csv")
    E.write_csv(_quoted_rows(t), path)
    return I.read_csv(t.spark, path, ROW)


@query("sink_csv_roundtrip", "tw", _ROW_CSV_SQL)
def _(t):
    path = scratch_path(t.spark, "csv")
    E.write_csv(_quoted_rows(t), path)
    return _typed(I.read_csv(t.spark, path, ROW))


@query("sink_jsonl_roundtrip", "tw", _ROW_SQL)
def _(t):
    path = scratch_path(t.spark, "jsonl")
    E.write_json_lines(_rows(t), path)
    return t.spark.read.schema(ROW).json(path)


@query(
    "sink_compressed_roundtrip", "tw",
    f"SELECT 'gzip' AS codec, * FROM ({_ROW_SQL}) UNION ALL SELECT 'lz4', * FROM ({_ROW_SQL})",
)
def _(t):
    out = None
    for codec in ("gzip", "lz4"):
        path = scratch_path(t.spark, f"jsonl-{codec}")
        E.write_json_lines(_rows(t), path, codec)
        back = t.spark.read.schema(ROW).json(path).select(F.lit(codec).alias("codec"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "agg_export_stats", "tw",
    """, j AS (SELECT octet_length(encode('{"id":"' || id || '","username":"' || username || '","retweet_count":' || retweet_count
        || ',"view_count":' || coalesce(view_count::VARCHAR, 'null') || '}')) AS b FROM tw)
    SELECT count(*) AS n_rows, sum(b)::BIGINT AS n_bytes, round(avg(b), 6) AS avg_bytes FROM j""",
)
def _(t):
    stats = E.export_stats(t.posts().select("id", "username", "retweet_count", "view_count"))
    return stats.withColumn("avg_bytes", F.round("avg_bytes", 6))


@query(
    "sink_fanout_tables", "tw sa",
    r""", hits AS (SELECT id, text, label FROM tw LEFT JOIN sa ON id = tweet_id),
    meta AS (SELECT len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')) + len(regexp_extract_all(text, '@[\p{L}\p{N}_]+'))
      + len(regexp_extract_all(text, 'https?://[!$-_a-z]+')) AS n FROM hits)
    SELECT 'posts' AS part, count(*) AS n FROM hits UNION ALL SELECT 'scores', count(*) FROM hits WHERE label IS NOT NULL
    UNION ALL SELECT 'metadata', sum(n)::BIGINT FROM meta""",
)
def _(t):
    from postlake.operators.joins import posts_with_scores

    posts = t.posts().withColumn("original_text", F.lit(None).cast("string"))
    paths = E.write_fanout(posts_with_scores(posts, t.scores()), scratch_path(t.spark, "fanout"))
    out = None
    for part, path in paths.items():
        n = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "sink_search_history", "tw",
    "SELECT query, 20 AS count, 'Top' AS product, count(*) AS fetched_count FROM tw GROUP BY query",
)
def _(t):
    """A history with one search per source, appended in two writes and read back."""
    found = t.posts().groupBy("query").agg(F.count(F.lit(1)).alias("fetched_count"))
    rows = found.select("query", F.lit(20).alias("count"), F.lit("Top").alias("product"), "fetched_count")
    path = scratch_path(t.spark, "history")
    half = F.pmod(F.xxhash64("query"), F.lit(2))
    for part in (0, 1):
        E.append_searches(rows.filter(half == part), path)
    return t.spark.read.parquet(path).drop("search_time").withColumn("count", F.col("count").cast("int"))


_SAMPLES = ", ".join("'" + text.replace("'", "''") + "'" for text in I.SAMPLE_TEXTS)


@query(
    "src_synthetic_posts", "",
    f"""SELECT 'tweet_' || doc_id AS id, [{_SAMPLES}][doc_id % 10 + 1] AS text,
      strftime(TIMESTAMP '2024-01-15 00:00:00' - to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS created_at,
      'user_' || doc_id % 100 AS username, 'en' AS lang, doc_id % 50 AS retweet_count, doc_id % 100 AS favorite_count,
      CASE doc_id % 10 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM documents""",
)
def _(t):
    return I.synthetic_posts(t.raw("documents"), "doc_id", now())


@query(
    "fn_compress_estimate", "payloads",
    """, s AS (SELECT id, octet_length(encode(payload)) AS b, length(payload) AS n, length(replace(payload, '"', '')) AS q,
        length(replace(payload, ' ', '')) AS w FROM payloads),
    r AS (SELECT id, b, CASE WHEN b < 100 THEN 1.0::DOUBLE ELSE least(1.5::DOUBLE + (n - q)::DOUBLE / n * 2 + (n - w)::DOUBLE / n * 2, 10) END AS ratio FROM s)
    SELECT id, b::BIGINT AS original_size, round(ratio, 6) AS estimated_ratio, floor(b / ratio)::BIGINT AS estimated_size,
      round(1 - floor(b / ratio) / b::DOUBLE, 6) AS estimated_savings FROM r""",
)
def _(t):
    return t.payloads().select("id", *K.estimate("payload"))


@query("job_pack_roundtrip", "payloads", "SELECT id, payload FROM payloads")
def _(t):
    return K.unpack(K.pack(t.payloads(), "id", "payload", "gzip"), "id")


#: What SQL can state of a packing: counts and sizes that go in, and whether more than a fifth is saved.
_PACKED = f"coalesce(strlen(payload) >= {K.PACK_THRESHOLD}, false)"


@query(
    "agg_compression_stats", "payloads",
    f"""SELECT count(*) FILTER ({_PACKED}) AS compressed_count, count(*) FILTER (NOT {_PACKED}) AS uncompressed_count, count(*) AS total_processed,
      count(*) FILTER ({_PACKED}) / count(*) AS compression_rate,
      coalesce(sum(strlen(payload)) FILTER ({_PACKED}), 0)::BIGINT AS original_size, true AS saves_a_fifth, true AS rates_agree FROM payloads""",
)
def _(t):
    stats = K.pack_stats(K.pack(t.payloads(), "id", "payload", "zlib"))
    agree = F.abs(F.col("avg_compression_ratio") * (1 - F.col("space_savings")) - 1) < 1e-9
    return stats.select(
        "compressed_count", "uncompressed_count", "total_processed", "compression_rate", "original_size",
        (F.col("space_savings") > 0.2).alias("saves_a_fifth"), agree.alias("rates_agree"),
    )


@query(
    "agg_size_reduction", "payloads",
    f"""SELECT codec, count(*) AS n, true AS saves_a_fifth FROM payloads, (VALUES ('zlib'), ('gzip')) c(codec)
      WHERE {_PACKED} GROUP BY codec""",
)
def _(t):
    packed = K.pack(t.payloads(), "id", "payload", "zlib").unionByName(K.pack(t.payloads(), "id", "payload", "gzip"))
    return K.size_reduction(packed).select("codec", "n", (F.col("avg_reduction_percent") > 20).alias("saves_a_fifth"))
