"""Streaming queries; the oracle of each one is the batch result."""

from pyspark.sql import functions as F

from postlake.plans import logs as LG
from postlake.plans.files import ROW
from postlake.plans.fixtures import Tables, iso
from postlake.plans.registry import query
from postlake.plans.scoring import FIXTURE, valence_sql
from postlake.session import scratch_path, spread_pieces
from postlake.sources.ingest import read_csv
from postlake.streaming import jobs as J
from postlake.streaming.sinks import stream_files, write_arrivals


def table_stream(t: Tables, name: str, max_bytes: int = 256 << 30):
    return stream_files(t.spark, t.path(name), t.raw(name).schema, max_bytes)


def text_stream(t: Tables):
    """Documents as a stream; a small table is dealt out like in a batch."""
    stream, pieces = table_stream(t, "documents"), spread_pieces(t.raw("documents"))
    return t.posts(stream if pieces is None else stream.repartition(pieces))


def log_stream(t: Tables, *columns: str, max_bytes: int = 256 << 30):
    return t.log(table_stream(t, "events", max_bytes)).select(*columns)


def log_arrivals(t: Tables, *columns: str, by: str = "ts_us"):
    """The whole log as files that come in order of time, some in each of four micro-batches or more."""
    path, log = scratch_path(t.spark, "log-arrivals"), t.log().select(*dict.fromkeys([*columns, by]))
    return stream_files(t.spark, path, log.schema, max_files=write_arrivals(log, by, path)).select(*columns)


USAGE_ORACLE = """SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS used,
      CASE WHEN count(*) > 300 THEN 1 ELSE 0 END AS over_limit FROM log GROUP BY 1, 2"""


def _usage(requests):
    used = J.window_usage(requests, "endpoint", "ts")
    return used.select(
        iso("window_start").alias("window_start"), "endpoint", "used", (F.col("used") > 300).cast("int").alias("over_limit")
    )


@query("stream_window_usage", "log", USAGE_ORACLE)
def _(t):
    return _usage(log_stream(t, "endpoint", "ts"))


@query("stream_window_usage_batches", "log", USAGE_ORACLE)
def _(t):
    """Windows stay open over several micro-batches."""
    return _usage(log_arrivals(t, "endpoint", "ts"))


def _per_second_to_interval(limits):
    return {k: (cap, rate * LG.INTERVAL) for k, (cap, rate) in limits.items()}


def _buckets(requests):
    decided = J.token_bucket(requests, ["endpoint"], "ts_us", "event_id", _per_second_to_interval(LG.ENDPOINT_LIMITS), LG.INTERVAL)
    return decided.select("event_id", "endpoint", "allowed")


@query("stream_token_bucket", "log", LG.BUCKET_ORACLE)
def _(t):
    return _buckets(log_stream(t, "endpoint", "event_id", "ts_us"))


@query("stream_token_bucket_batches", "log", LG.BUCKET_ORACLE)
def _(t):
    """Tokens and refills go from micro-batch to micro-batch."""
    return _buckets(log_arrivals(t, "endpoint", "event_id", "ts_us"))


def _two_buckets(requests):
    app = (LG.APP_LIMIT[0], LG.APP_LIMIT[1] * LG.INTERVAL)
    decided = J.two_buckets(requests, ["endpoint"], ["source"], "ts_us", "event_id", _per_second_to_interval(LG.ENDPOINT_LIMITS), app, LG.INTERVAL)
    return decided.select("event_id", "endpoint", "source", "endpoint_allowed", "app_allowed", "allowed")


@query("stream_two_buckets", "log", LG.TWO_ORACLE)
def _(t):
    return _two_buckets(log_stream(t, "endpoint", "source", "event_id", "ts_us"))


@query("stream_two_buckets_batches", "log", LG.TWO_ORACLE)
def _(t):
    """Both buckets of a request go on from what earlier micro-batches have left."""
    return _two_buckets(log_arrivals(t, "endpoint", "source", "event_id", "ts_us"))


@query("stream_admission_delay", "log", LG.DELAY_ORACLE)
def _(t):
    requests = log_stream(t, "endpoint", "event_id", "ts_us")
    decided = J.token_bucket(
        requests, ["endpoint"], "ts_us", "event_id", _per_second_to_interval(LG.ENDPOINT_LIMITS), LG.INTERVAL, LG.MAX_WAIT,
    )
    return decided.select("event_id", "endpoint", "allowed", F.round("delay_s", 3).alias("delay_s"))


@query(
    "stream_score", "tw",
    ", " + valence_sql("tw", "text") + " SELECT id, compound AS sentiment_compound, label AS sentiment_label FROM valence",
)
def _(t):
    posts = text_stream(t).select("id", "text")
    return J.score_stream(posts, lexicon=FIXTURE).select("id", "sentiment_compound", "sentiment_label")


INTAKE_ORACLE = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
      CASE WHEN row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) <= 320 THEN 1 ELSE 0 END AS admitted FROM log"""


def _intake(requests):
    arrivals = requests.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return J.bounded_intake(arrivals, "day", "event_id", 320)


@query("stream_bounded_intake", "log", INTAKE_ORACLE)
def _(t):
    return _intake(log_stream(t, "event_id", "ts"))


@query("stream_bounded_intake_batches", "log", INTAKE_ORACLE)
def _(t):
    """The places of a day are given out over several micro-batches, in order of the ids."""
    return _intake(log_arrivals(t, "event_id", "ts", by="event_id"))


def _shown(docs):
    """Posts as pages of a search show them, every seventh one again."""
    again = F.when(F.col("id").cast("bigint") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    arrivals = docs.select("id", F.explode(again).alias("copy"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("id").cast("bigint"), F.lit(1000)) * 60 + F.col("copy") * 60)
    return arrivals.select("id", at.alias("seen_at"))


@query("stream_dedup", "search_pages", "SELECT DISTINCT id FROM search_pages")
def _(t):
    return J.dedup(_shown(t.posts(table_stream(t, "documents")).select("id")), "id", "seen_at").select("id")


@query("stream_dedup_batches", "search_pages", "SELECT DISTINCT id FROM search_pages")
def _(t):
    """A post and its copy may come in different micro-batches."""
    path, shown = scratch_path(t.spark, "pages-arrivals"), _shown(t.posts().select("id"))
    stream = stream_files(t.spark, path, shown.schema, max_files=write_arrivals(shown, "seen_at", path))
    return J.dedup(stream, "id", "seen_at").select("id")


@query("stream_export", "tw", "SELECT 'json' AS format, {c} FROM tw UNION ALL SELECT 'csv', {c} FROM tw".format(c="id, text, original_text, username, retweet_count, view_count"))
def _(t):
    rows = t.posts(table_stream(t, "documents")).select(*ROW.names)
    as_json = t.spark.read.schema(ROW).json(J.export(rows, "json"))
    csv = read_csv(t.spark, J.export(rows, "csv"), ROW)
    as_csv = csv.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROW.fields])
    return as_json.select(F.lit("json").alias("format"), "*").unionByName(as_csv.select(F.lit("csv").alias("format"), "*"))


UPSERT_ORACLE = """SELECT user_id, event_id, endpoint, status FROM log
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


@query("stream_upsert_batches", "log", UPSERT_ORACLE)
def _(t):
    """Runs of several micro-batches, merged by level; they come in order of time, not of the ids that decide."""
    return J.upsert(log_arrivals(t, "user_id", "event_id", "endpoint", "status"), ["user_id"], "event_id")


@query("stream_upsert", "log", UPSERT_ORACLE)
def _(t):
    return J.upsert(log_stream(t, "user_id", "event_id", "endpoint", "status"), ["user_id"], "event_id")
