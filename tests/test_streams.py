"""Streams that arrive in several micro-batches, some of them after a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_ordered import brute_bucket

from postlake.operators import scoring as N
from postlake.session import scratch_path
from postlake.streaming import jobs as J
from postlake.streaming.sinks import batch_writer, run_batches, stream_files, write_arrivals


def arrive(spark, df, order, parts):
    """Write ``parts`` files one after the other, so that their times of arrival follow ``order``."""
    path = scratch_path(spark, "t-arrive")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(11)
    at, rows = 0, []
    for i in range(600):
        at += rnd.randrange(1, 4_000_000)
        rows.append((rnd.choice("abbb"), at, i))
    return spark.createDataFrame(rows, "k string, ts bigint, id bigint"), rows


@pytest.mark.parametrize("max_wait", [0.0, 9.0])
def test_bucket_across_batches(spark, log, max_wait):
    df, rows = log
    path = arrive(spark, df, "ts", 5)
    stream = stream_files(spark, path, df.schema, max_files=1)
    out = J.token_bucket(stream, ["k"], "ts", "id", {"a": (3.0, 0.2), "b": (5.0, 0.4)}, 1.0, max_wait)
    assert out.select("batch_id").distinct().count() == 5
    got = {r["id"]: (r["allowed"], r["delay_s"]) for r in out.collect()}
    for k, limit in (("a", (3.0, 0.2)), ("b", (5.0, 0.4))):
        mine = [r for r in rows if r[0] == k]
        for r, (ok, delay) in zip(mine, brute_bucket([r[1] for r in mine], *limit, 1.0, max_wait)):
            assert got[r[2]] == (ok, pytest.approx(delay, abs=1e-6))


def test_two_buckets_across_batches(spark, log):
    """Both buckets are decided in the request's micro-batch; a key without a limit is not limited."""
    df, rows = log
    df = df.withColumn("app", F.lit(None).cast("string"))
    stream = stream_files(spark, arrive(spark, df, "ts", 5), df.schema, max_files=1)
    out = J.two_buckets(stream, ["k"], ["app"], "ts", "id", {"b": (5.0, 0.4)}, (9.0, 0.7), 1.0)
    got = {r["id"]: (r["endpoint_allowed"], r["app_allowed"], r["allowed"]) for r in out.collect()}
    assert out.select("batch_id").distinct().count() == 5
    own = {r[2]: 1 for r in rows}
    mine = [r for r in rows if r[0] == "b"]
    own |= {r[2]: ok for r, (ok, _) in zip(mine, brute_bucket([r[1] for r in mine], 5.0, 0.4, 1.0, 0.0))}
    app = brute_bucket([r[1] for r in rows], 9.0, 0.7, 1.0, 0.0)
    assert got == {r[2]: (own[r[2]], ok, own[r[2]] * ok) for r, (ok, _) in zip(rows, app)}


def test_a_batch_that_comes_again(spark, log, monkeypatch):
    """A micro-batch that dies after its state was kept, and is run again, sees the state before it."""
    df, rows = log
    path, calls = arrive(spark, df, "ts", 4), []
    run = J.run_batches

    def twice(stream, write):
        run(stream, lambda batch, n: [write(batch, n), write(batch, n)] and None)

    monkeypatch.setattr(J, "run_batches", twice)
    out = J.token_bucket(stream_files(spark, path, df.schema, max_files=1), ["k"], "ts", "id", (5.0, 0.4))
    got = {r["id"]: r["allowed"] for r in out.collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        assert [got[r[2]] for r in mine] == [ok for ok, _ in brute_bucket([r[1] for r in mine], 5.0, 0.4, 1.0, 0.0)]


def test_restart_continues(spark, log):
    df, _ = log
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("t-in", "t-sink", "t-cp"))
    for low, high in ((0, 200), (200, 600)):
        df.filter((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(path)
        run_batches(stream_files(spark, path, df.schema), batch_writer(sink), checkpoint=checkpoint)
    out = spark.read.parquet(sink)
    assert out.count() == 600 and out.select("id").distinct().count() == 600
    assert out.select("batch_id").distinct().count() == 2


def test_window_usage(spark, log):
    df, _ = log
    timed = df.withColumn("at", F.timestamp_micros("ts"))
    stream = stream_files(spark, arrive(spark, timed, "ts", 4), timed.schema, max_files=1)
    got = {(r["window_start"], r["k"]): r["used"] for r in J.window_usage(stream, "k", "at", "5 minutes").collect()}
    want = timed.groupBy(F.window("at", "5 minutes").alias("w"), "k").count().collect()
    assert got == {(r["w"]["start"], r["k"]): r["count"] for r in want}


def test_dedup_upsert_intake(spark):
    rows = [(i % 50, i, i // 60) for i in range(180)]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, grp bigint").withColumn("at", F.timestamp_seconds("seq"))
    path = arrive(spark, df, "seq", 3)
    stream = lambda: stream_files(spark, path, df.schema, max_files=1)
    assert sorted(r["id"] for r in J.dedup(stream(), "id", "at").collect()) == list(range(50))
    latest = {r["id"]: r["seq"] for r in J.upsert(stream(), ["id"], "seq").collect()}
    assert latest == {i: max(s for k, s, _ in rows if k == i) for i in range(50)}
    taken = J.bounded_intake(stream(), "grp", "seq", 45).collect()
    assert sorted((r["id"], r["seq"], r["grp"], r["admitted"]) for r in taken) == sorted((*r, int(r[1] % 60 < 45)) for r in rows)


def test_dedup_over_a_long_time(spark):
    """Ids that come again after months, later and earlier in event time, are still known; null is an id."""
    rows = [(None if i % 50 == 7 else i % 50, i, (i * 37 % 180) * 86_400) for i in range(180)]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, s bigint").withColumn("at", F.timestamp_seconds("s"))
    out = J.dedup(stream_files(spark, arrive(spark, df, "seq", 6), df.schema, max_files=1), "id", "at").collect()
    want = {}
    for start in range(0, 180, 30):
        best = {}
        for r in rows[start : start + 30]:
            if r[0] not in want and (r[0] not in best or r[2] < best[r[0]][2]):
                best[r[0]] = r
        want |= best
    assert sorted(((r["id"], r["seq"]) for r in out), key=str) == sorted(((k, v[1]) for k, v in want.items()), key=str)


def test_intake_over_batches(spark):
    """Arrivals that are spread over several micro-batches get their places once."""
    rows = [(i, i, None if i // 60 == 2 else i // 60) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, grp bigint")
    path = arrive(spark, df, "seq", 9)
    taken = J.bounded_intake(stream_files(spark, path, df.schema, max_files=1), "grp", "seq", 32).collect()
    assert sorted((r["seq"], r["admitted"]) for r in taken) == [(i, int(i % 60 < 32)) for i in range(240)]


def test_intake_query_over_batches(spark, monkeypatch):
    """The registered query with its events in five files, one to a micro-batch, gives what a single file gives."""
    from postlake.plans import streams
    from postlake.plans.registry import load_all

    sf = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
    events, run = spark.read.parquet(f"{sf}/events.parquet"), load_all()["stream_bounded_intake"]
    folder = scratch_path(spark, "t-intake")
    rows, size = events.orderBy("event_id").collect(), -(-events.count() // 5)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], events.schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(J, "bounded_intake", lambda s, a, o, cap, f=J.bounded_intake: f(s, a, o, 7))
    whole = sorted(map(tuple, run(spark, sf).collect()))
    monkeypatch.setattr(streams, "stream_files", lambda spark, path, schema, *_: stream_files(spark, path, schema, max_files=1))
    assert sorted(map(tuple, run(spark, folder).collect())) == whole and {r[2] for r in whole} == {0, 1}


def test_streams_without_a_batch(spark):
    schema = spark.createDataFrame([], "id bigint, seq bigint, grp bigint").schema
    path = scratch_path(spark, "t-empty")
    spark.createDataFrame([], schema).write.parquet(path)
    stream = lambda: stream_files(spark, path, schema).filter("id > 0")
    assert J.bounded_intake(stream(), "grp", "seq", 3).columns == ["id", "seq", "grp", "admitted"]
    assert J.upsert(stream(), ["id"], "seq").count() == 0


def test_score_and_export(spark):
    df = spark.createDataFrame([(str(i), ["love it", "bad, bad", "table", ""][i % 4]) for i in range(40)], "id string, text string")
    path = arrive(spark, df, "id", 3)
    stream = lambda: stream_files(spark, path, df.schema, max_files=1)
    streamed = {r["id"]: r["sentiment_compound"] for r in J.score_stream(stream()).collect()}
    assert streamed == {r["id"]: r["sentiment_compound"] for r in N.score(df).collect()}
    out = spark.read.schema(df.schema).json(J.export(stream(), "json"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_arrivals_follow_the_order(spark):
    """Micro-batches take ranges of the column in order; equal values come together, nulls first."""
    rows = [(i, None if i % 50 == 0 else (i * 7919) % 40) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, at bigint")
    path = scratch_path(spark, "t-arrivals")
    stream = stream_files(spark, path, df.schema, max_files=write_arrivals(df, "at", path, parts=5))
    seen: list[list] = []
    run_batches(stream, lambda batch, _: seen.append([(r["id"], r["at"]) for r in batch.collect()]))
    assert len(seen) >= 4 and sorted(x for part in seen for x in part) == sorted(rows)
    low = [[-1 if at is None else at for _, at in part] for part in seen if part]
    assert all(max(a) < min(b) for a, b in zip(low, low[1:]))


@pytest.mark.parametrize("n", [0, 1])
def test_arrivals_of_tiny_tables(spark, n):
    df = spark.range(n).withColumn("at", F.lit(None).cast("timestamp"))
    path = scratch_path(spark, "t-arrivals")
    stream = stream_files(spark, path, df.schema, max_files=write_arrivals(df, "at", path))
    assert J.dedup(stream, "id", "at").count() == n
