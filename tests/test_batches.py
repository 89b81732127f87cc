"""What a micro-batch costs follows its rows, not the session's partitions or the number of passes over them."""

import pytest
from pyspark.sql import functions as F

from postlake.operators import ordered as O
from postlake.session import scratch_path
from postlake.streaming import jobs as J, sinks
from postlake.streaming.sinks import run_batches, stream_files, write_arrivals


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_small_table_is_cut_into_few_slices(spark, many_partitions, monkeypatch):
    assert O.slices_for(spark.range(1000), 400) == 16
    for size, wanted in ((50 << 20, 51), (1 << 30, 200), (64 << 30, 1025), (None, 200)):
        monkeypatch.setattr(O, "input_bytes", lambda _, size=size: size)
        assert O.slices_for(spark.range(10), 400) == wanted
    monkeypatch.setattr(O, "input_bytes", lambda _: 64 << 30)
    assert O.slices_for(spark.range(10), 1 << 20) == 256


def test_the_first_bucket_decides_once(spark, monkeypatch):
    """What deals rows out by range reads them twice; the second bucket's input is stored rows and no decisions."""
    df = spark.range(400).select(F.lit("a").alias("k"), F.lit("x").alias("app"), (F.col("id") * 900_000).alias("ts"), "id")
    path, read, replay = scratch_path(spark, "t-once"), [], J.replay
    files = write_arrivals(df, "ts", path)

    def seen(requests, *args, **options):
        read.append("MapInArrow" in requests._jdf.queryExecution().optimizedPlan().toString())
        return replay(requests, *args, **options)

    monkeypatch.setattr(J, "replay", seen)
    made, scratch = [], J.scratch_path
    monkeypatch.setattr(J, "scratch_path", lambda s, label: made.append(scratch(s, label)) or made[-1])
    limits = (5.0, 0.4), (9.0, 0.7)
    out = J.two_buckets(stream_files(spark, path, df.schema, max_files=files), ["k"], ["app"], "ts", "id", *limits)
    assert len(read) == 8 and not any(read)
    got = {r["id"]: (r["endpoint_allowed"], r["app_allowed"]) for r in out.collect()}
    whole = J.two_buckets(stream_files(spark, path, df.schema), ["k"], ["app"], "ts", "id", *limits)
    assert got == {r["id"]: (r["endpoint_allowed"], r["app_allowed"]) for r in whole.collect()} and len(got) == 400
    # The rows in between go with their micro-batch.
    between = [p for p in made if "decided-once" in p]
    assert len(between) == 2 and not any(spark._jvm.java.io.File(f"{p}/batch_id={i}").exists() for p in between for i in range(4))


@pytest.mark.parametrize("size", [640 << 20, 40 << 20])
def test_arrivals_of_a_larger_table(spark, monkeypatch, size):
    """At least as many micro-batches as asked for, each of several files, still in order."""
    monkeypatch.setattr(sinks, "input_bytes", lambda _: size)
    df, path = spark.range(2000).select("id", F.pmod(F.col("id") * 7919, F.lit(2000)).alias("at")), scratch_path(spark, "t-larger")
    files, seen = write_arrivals(df, "at", path), []
    run_batches(stream_files(spark, path, df.schema, max_files=files), lambda batch, _: seen.append([r["at"] for r in batch.collect()]))
    assert files == {640 << 20: 21, 40 << 20: 2}[size] and 4 <= len(seen) <= 5
    assert sorted(x for part in seen for x in part) == list(range(2000)) and all(max(a) < min(b) for a, b in zip(seen, seen[1:]))


def test_a_range_without_rows_does_not_make_batches_fewer(spark, monkeypatch):
    monkeypatch.setattr(sinks, "input_bytes", lambda _: 40 << 20)
    df, path = spark.range(600).select("id", (F.col("id") % 6).alias("at")), scratch_path(spark, "t-few")
    batches = []
    run_batches(stream_files(spark, path, df.schema, max_files=write_arrivals(df, "at", path)), lambda batch, _: batches.append(batch.count()))
    assert len(batches) >= 4 and sum(batches) == 600
