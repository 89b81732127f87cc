"""Ordered operators on keys that span many slices, against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import joins as J, limits, ordered as O, windows as W


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else rnd.choice("abc")
        rows.append((key, i // 3 * 1_000_000 if key == "hot" else i * 700_000, i, rnd.random() < 0.4, rnd.choice([1, -1, -1, 0]), rnd.randrange(100) / 4))
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, bad boolean, step int, v double").repartition(6)
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    return df, by_key


SLICES = O.slices_for


@pytest.fixture(autouse=True)
def many_slices(monkeypatch):
    monkeypatch.setattr(O, "slices_for", lambda df, state_bytes: 13)


def test_positions(events):
    df, by_key = events
    got = {r["id"]: r["rn"] for r in O.with_position(df, ["k"], ["ts", "id"]).collect()}
    assert got == {r[2]: i for rows in by_key.values() for i, r in enumerate(rows, 1)}


def test_one_exchange_of_the_log(spark, events):
    """Both readings use one range exchange, also when the caller keeps few columns and filters."""
    df, _ = events
    for out in (W.rolling_mean(df, ["k"], ["ts", "id"], "v", 7), W.clamped_gauge(df, ["k"], ["ts", "id"], F.col("step")).filter("k = 'hot' and id > 5").select("gauge")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("- Exchange rangepartitioning") == 1 and "ReusedExchange" in plan and "Window" not in plan


def test_slices_follow_the_tables(spark):
    """Not the estimates behind a join or a self-join, which multiply."""
    log = spark.read.parquet(os.environ.get("TESTDATA", "/root/testdata") + "/sf0.01/events.parquet")
    pairs = log.join(log.select("user_id", F.col("value").alias("other")), "user_id").join(log.select("user_id", "ts").alias("x"), "user_id")
    assert SLICES(log, 400) == SLICES(pairs, 400) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_plan_with_other_slices_fails(spark, events, monkeypatch):
    df, _ = events
    ranged, calls = O._ranged, []

    def marks_that_move(*args):
        return ranged(*args).withColumn(O._MARK, F.rand())

    monkeypatch.setattr(O, "_ranged", marks_that_move)
    with pytest.raises(Exception, match="different slices|CAST|cast"):
        O.with_position(df, ["k"], ["ts", "id"]).collect()


@pytest.mark.parametrize("slices", [1, 13, 200])
@pytest.mark.parametrize("depth", [1, 2, 40, 5000])
def test_rolling(events, depth, slices, monkeypatch):
    monkeypatch.setattr(O, "slices_for", lambda df, state_bytes: slices)
    df, by_key = events
    out = W.rolling_mean(df, ["k"], ["ts", "id"], "v", depth)
    got = {r["id"]: (r["rolling_mean"], r["n_in_window"]) for r in out.collect()}
    assert len(got) == df.count()
    for rows in by_key.values():
        for i, r in enumerate(rows):
            last = [x[5] for x in rows[max(0, i - depth + 1) : i + 1]]
            assert got[r[2]] == (pytest.approx(sum(last) / len(last)), len(last))


def test_values_that_are_no_numbers(spark):
    """They spoil only the windows that hold them; nulls are not counted; null and NaN keys are keys."""
    nan, inf = float("nan"), float("inf")
    values = [1.0, None, nan, 2.0, 3.0, inf, 4.0, 1e17, 5.0, 6.0, None, None, None, 7.0]
    rows = [(k, i, v) for k in (None, nan, 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k double, i int, v double").repartition(5)
    got = {(str(r["k"]), r["i"]): (r["rolling_mean"], r["n_in_window"]) for r in W.rolling_mean(df, ["k"], ["i"], "v", 3).collect()}
    assert len(got) == len(rows)
    for k in ("None", "nan", "1.0"):
        for i in range(len(values)):
            last = [v for v in values[max(0, i - 2) : i + 1] if v is not None]
            mean, n = got[k, i]
            assert n == len(last)
            assert (mean is None) if not last else mean == pytest.approx(sum(last) / len(last), rel=1e-12, nan_ok=True)
    assert W.rolling_mean(df.limit(0), ["k"], ["i"], "v", 3).collect() == []


def test_many_small_keys(spark):
    df = spark.range(30_000).select((F.col("id") % 9_000).alias("k"), "id", (F.col("id") * 1.0).alias("v"), F.lit(-1).alias("step"))
    means = {r["id"]: (r["rolling_mean"], r["n_in_window"]) for r in W.rolling_mean(df, ["k"], ["id"], "v", 2).collect()}
    assert means == {i: ((i + max(i - 9_000, i % 9_000)) / 2, 2 if i >= 9_000 else 1) for i in range(30_000)}
    assert W.clamped_gauge(df, ["k"], ["id"], F.col("step")).filter("gauge <> 0").count() == 0


def test_streaks(events):
    df, by_key = events
    got = {r["id"]: (r["streak"], r["disabled"]) for r in W.failure_streaks(df, ["k"], ["ts", "id"], F.col("bad"), 4).collect()}
    for rows in by_key.values():
        streak, off = 0, 0
        for r in rows:
            streak = streak + 1 if r[3] else 0
            off = off or int(streak >= 4)
            assert got[r[2]] == (streak, off)


def test_gauge(events):
    df, by_key = events
    got = {r["id"]: r["gauge"] for r in W.clamped_gauge(df, ["k"], ["ts", "id"], F.col("step")).collect()}
    for rows in by_key.values():
        level = 0
        for r in rows:
            level = max(0, level + r[4])
            assert got[r[2]] == level


def test_batches_and_backoff(events):
    df, by_key = events
    got = {r["id"]: r["batch_no"] for r in W.batch_numbers(df, ["k"], ["ts", "id"], 7).collect()}
    for rows in by_key.values():
        assert [got[r[2]] for r in rows] == [i // 7 for i in range(len(rows))]
    timed = df.withColumn("at", F.timestamp_micros("ts"))
    back = W.backoff_schedule(timed, ["k"], ["ts", "id"], "at").filter("k = 'a'").orderBy("hit_no").limit(6).collect()
    assert [r["cooldown_minutes"] for r in back] == [15, 30, 60, 120, 120, 120]


def test_last_n_and_lru(events):
    df, by_key = events
    got = W.last_n(df, ["k"], [F.desc("ts"), F.desc("id")], 5).collect()
    for k, rows in by_key.items():
        assert [r["id"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["ord"])] == [r[2] for r in rows[-5:]]
    kept = W.lru_retain(df, "k", "ts", 2).collect()
    want = sorted(by_key, key=lambda k: (-by_key[k][-1][1], k))[:2]
    assert [r["k"] for r in kept] == want


def brute_bucket(times, capacity, rate, interval, max_wait):
    tokens, last, out = float(capacity), times[0], []
    for now in times:
        elapsed = (now - last) / 1e6
        if elapsed >= interval:
            tokens = min(capacity, tokens + elapsed / interval * rate)
            last = now
        missing = 1.0 - tokens
        wait = missing / rate * interval if missing > 0 else 0.0
        if missing <= 0 or max_wait is None or wait <= max_wait:
            tokens -= 1
            out.append((1, wait))
        else:
            out.append((0, 0.0))
    return out


@pytest.mark.parametrize("interval, capacity, rate, max_wait", [(1.0, 10, 0.3, 0.0), (7.5, 4, 2.0, 0.0), (30.0, 3, 1.5, 25.0), (0.4, 2, 0.1, 3.0), (400.0, 5, 3.0, 0.0), (5.0, 3, 1.0, None)])
def test_replay(events, interval, capacity, rate, max_wait):
    df, by_key = events
    done = limits.replay(df.select("k", "ts", "id"), ["k"], "ts", "id", F.lit(capacity), F.lit(rate), interval, max_wait)
    got = {r["id"]: (r["allowed"], r["delay_s"]) for r in done.collect()}
    for rows in by_key.values():
        want = brute_bucket([r[1] for r in rows], capacity, rate, interval, max_wait)
        for r, (ok, delay) in zip(rows, want):
            assert got[r[2]][0] == ok
            assert got[r[2]][1] == pytest.approx(delay, abs=1e-6)
    assert len(got) == df.count()


@pytest.mark.parametrize("max_wait", [0.0, 40.0])
def test_bucket_states_meet(max_wait):
    """Any cut of a log into stretches gives the tokens of the whole log, through open states and regeneration points."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(9)
    for trial in range(60):
        idle = rnd.choice([0.0, 0.02, 0.3])
        times, now = [], 0
        for _ in range(400):
            now += rnd.randrange(90_000_000) if rnd.random() < idle else rnd.randrange(3_000_000)
            times.append(now)
        bucket, capacity, rate = limits.Bucket("t", 5.0, max_wait), 4.0, 1.7

        def columns(lo, hi):
            n = hi - lo
            of = lambda x: pa.array([x] * n, pa.float64())
            return {"t": pa.array(times[lo:hi]), "_capacity": of(capacity), "_rate": of(rate), "_tokens": of(None), "_last": pa.array([None] * n, pa.int64())}

        new, go = np.zeros(1, np.int64), np.zeros(0, np.int64)
        want = bucket.run(None, columns(0, 400), new, 400)
        cuts = sorted(rnd.sample(range(1, 400), 3))
        refills, state = None, None
        for lo, hi in zip([0, *cuts], [*cuts, 400]):
            opened, fresh = (None, new) if refills is None else (bucket.opened(refills), go)
            # a stretch may come in several batches
            mid = (lo + hi) // 2
            part = opened
            for a, b, f in ((lo, mid, fresh), (mid, hi, go)):
                if a < b:
                    part = bucket.run(part, columns(a, b), f if a == lo else go, b - a)[1]
            state = part if state is None else bucket.join(state, part)
            own = bucket.before.run(None, columns(lo, hi), new, hi - lo)[1]
            refills = own if refills is None else bucket.before.join(refills, own)
            assert state[0] is None
        assert state[1:] == want[1][1:]


def test_kept_buckets_go_on(spark, events):
    """Two halves of a log, the second one with what the first one left, decide like the whole log."""
    df, by_key = events
    log, limit = df.select("k", "ts", "id"), (F.lit(4.0), F.lit(2.0), 7.5, 25.0)
    whole = {r["id"]: (r["allowed"], r["delay_s"]) for r in limits.replay(log, ["k"], "ts", "id", *limit).collect()}
    none = spark.createDataFrame([], "k string, tokens_left double, last_refill bigint")
    early = limits.replay(log.filter("ts < 600000000"), ["k"], "ts", "id", *limit, kept=none)
    got = {r["id"]: (r["allowed"], r["delay_s"]) for r in early.collect()}
    left = early.groupBy("k").agg(F.max_by(F.struct("tokens_left", "last_refill"), F.struct("ts", "id")).alias("s")).select("k", "s.*")
    left = left.unionByName(spark.createDataFrame([("unseen", 1.0, 5)], left.schema))
    late = limits.replay(log.filter("ts >= 600000000"), ["k"], "ts", "id", *limit, kept=left)
    got |= {r["id"]: (r["allowed"], r["delay_s"]) for r in late.collect()}
    assert got == whole


def test_keys_without_a_limit(spark):
    df = spark.createDataFrame([(k, 1_000_000, i) for i in range(6) for k in ("a", "b", None)], "k string, ts bigint, id bigint")
    capacity = F.when(F.col("k") == "a", 2.0)
    done = limits.replay(df, ["k"], "ts", "id", capacity, F.lit(1.0)).collect()
    assert {k: sum(r["allowed"] for r in done if r["k"] == k) for k in ("a", "b", None)} == {"a": 2, "b": 6, None: 6}


def test_bucket_accuracy(spark):
    """Ten tokens taken at once; five more requests at the same moment are all denied."""
    df = spark.createDataFrame([("k", 1_000_000, i) for i in range(15)], "k string, ts bigint, id bigint")
    done = limits.replay(df, ["k"], "ts", "id", F.lit(10), F.lit(1.0)).collect()
    assert sum(r["allowed"] for r in done) == 10
    assert all(r["allowed"] == int(r["id"] < 10) for r in done)


def test_two_buckets_charge_both(spark):
    df = spark.createDataFrame([("e1", "s", i, i) for i in range(3)] + [("e2", "s", 10 + i, 10 + i) for i in range(3)], "e string, s string, ts bigint, id bigint")
    done = limits.two_buckets(df, ["e"], ["s"], "ts", "id", (F.lit(1), F.lit(0.1)), (F.lit(4), F.lit(0.1)))
    got = {r["id"]: (r["endpoint_allowed"], r["app_allowed"], r["allowed"]) for r in done.collect()}
    assert got == {0: (1, 1, 1), 1: (0, 1, 0), 2: (0, 1, 0), 10: (1, 1, 1), 11: (0, 0, 0), 12: (0, 0, 0)}


def test_hot_keys_are_spread(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    right = left.filter("key is not null").select("key").distinct().withColumn("value", F.concat(F.lit("v"), "key"))
    right = right.filter(F.xxhash64("key") % 4 != 0).unionByName(spark.sql("select 'hot' key, 'vhot' value")).distinct()
    assert [r[0] for r in J.hot_keys(left, "key").collect()] == ["hot"]
    got = {r["id"]: r["value"] for r in J.lookup_left_join(left, right, "key", ["id"], salts=5).collect()}
    want = {r["id"]: r["value"] for r in left.join(right, "key", "left").collect()}
    assert got == want and len(got) == 4000
