import pytest
from pyspark.sql import functions as F

from postlake.functions import packing as K
from postlake.operators import joins as J, search as Q, shards as D, store as S
from postlake.schema import POST
from postlake.session import exists, scratch_path, scratch_scope
from postlake.sources import export as E, ingest as I


@pytest.fixture(scope="module")
def posts(spark):
    rows = [
        ("1", "Gold price today", None, "2024-01-05", "alice", "en", "gold"),
        ("2", "golden hour", "GOLD!", "2024-02-01", "Bob", "en", "gold"),
        ("3", "bitcoin and Gold", None, None, "alice", "fr", "btc"),
        ("4", None, None, "2024-02-01", None, None, None),
        ("5", "#Gold @Alice_1", "", "2023-12-31", "carol", "en", "gold"),
    ]
    return spark.createDataFrame(rows, "id string, text string, original_text string, created_at string, username string, lang string, query string")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_predicates(posts):
    pick = lambda c: sorted(ids(posts.filter(c)))
    assert pick(Q.keywords("gold")) == ["1", "3", "5"]
    assert pick(Q.keywords("gold", "bitcoin")) == ["3"]
    assert pick(Q.exclude("gold")) == ["2", "4"]
    assert pick(Q.any_of("hour", "today")) == ["1", "2"]
    assert pick(Q.phrase("GOLD price")) == ["1"]
    assert pick(Q.from_user("bob")) == ["2"]
    assert pick(Q.mentions_user("alice_1")) == ["5"] and pick(Q.mentions_user("alice")) == []
    assert pick(Q.has_hashtag("gold")) == ["5"]
    assert pick(Q.since("2024-01-01") & Q.until("2024-02-01")) == ["1"]
    assert pick(Q.language("fr") | Q.keywords("c++")) == ["3"]


def test_search_and_order(posts):
    assert ids(Q.search_text(posts, "gold")) == ["2", "1", "5", "3"]
    assert ids(Q.newest(posts)) == ["2", "4", "1", "5", "3"]
    assert ids(Q.newest(posts, 2, 1)) == ["4", "1"]
    assert ids(Q.newest(posts, None, 3)) == ["5", "3"]
    assert len(ids(Q.newest(posts, 0))) == 5
    with pytest.raises(ValueError):
        Q.results(posts, "Best", 3)
    assert len(ids(Q.results(posts, "Latest", 0))) == 1


def test_filters(posts):
    assert ids(S.where_in(posts, "id", [])) == []
    assert len(ids(S.where_equal(posts, "query", None))) == 5
    assert ids(S.between_dates(posts, "2024-01-05", "2024-02-01")) == ["2", "4", "1"]


def test_upsert_replaces_whole_rows(spark):
    current = spark.createDataFrame([("1", "a", 5, 0), ("2", "b", 6, 0)], "id string, text string, view_count bigint, seq bigint")
    incoming = spark.createDataFrame([("1", "new", 2), ("3", "c", 1), ("1", "newer", 3)], "id string, text string, seq bigint")
    got = {r["id"]: (r["text"], r["view_count"]) for r in S.upsert(current, incoming, ["id"], "seq").collect()}
    assert got == {"1": ("newer", 0), "2": ("b", 6), "3": ("c", 0)}


def test_keep_last_drops_copies_before_the_shuffle(spark):
    df = S.keep_last(spark.range(100).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.desc("id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_joins(spark, posts):
    scores = spark.createDataFrame(
        [("1", "vader", "positive", 0.5, None), ("9", "vader", "negative", -0.5, None)],
        "tweet_id string, method string, label string, compound double, polarity double",
    ).withColumns({c: F.lit(None).cast("double") for c in ("positive", "negative", "neutral", "subjectivity")})
    nested = {r["id"]: r["sentiment"] for r in S.nest_sentiment(J.posts_with_scores(posts, scores)).collect()}
    assert nested["1"]["compound"] == 0.5 and nested["1"]["polarity"] is None and nested["2"] is None
    assert [r["tweet_id"] for r in J.orphans(scores, posts, "tweet_id", "id").collect()] == ["9"]
    kept, gone = J.cascade_delete(scores, posts.filter("id = '1'"), "tweet_id", "id")
    assert [r["tweet_id"] for r in kept.collect()] == ["9"] and [r["tweet_id"] for r in gone.collect()] == ["1"]


def test_metadata_prefers_the_original(posts):
    got = [(r["tweet_id"], r["value"]) for r in S.post_metadata(posts.withColumn("original_text", F.when(F.col("id") == "2", "#x"))).collect()]
    assert sorted(got) == [("2", "#x"), ("5", "#Gold"), ("5", "@Alice_1")]


def test_sharded_table(spark, posts):
    path = scratch_path(spark, "t-shards")
    D.write_sharded(D.with_shard(posts), path)
    table = D.read_sharded(spark, path)
    assert table.count() == 5
    scan = D.scan(table, "2024_Q1")
    assert "PartitionFilters: [isnotnull(shard_key" in scan._jdf.queryExecution().executedPlan().toString() or "shard_key IN" in scan._jdf.queryExecution().executedPlan().toString()
    assert sorted(ids(scan)) == ["1", "2", "4"]
    assert sorted(ids(D.scan_range(table, "2023-11-01", "2024-01-01"))) == ["1", "2", "4", "5"]
    fresh = D.with_shard(posts.filter("id = '1'").withColumn("text", F.lit("again")))
    D.write_sharded(fresh, path, mode="overwrite")
    assert D.read_sharded(spark, path).count() == 3
    assert sum(r["n"] for r in D.totals(D.with_shard(posts)).collect() if r["is_total"]) == 5


def test_file_formats(spark):
    rows = [("1", 'say "hi", ok', 3), ("2", "line\nbreak", None), ("3", "", 1), ("4", None, 0), ("5", " pad ", 2), ("6", "back\\slash", 2)]
    df = spark.createDataFrame(rows, "id string, text string, retweet_count bigint")
    want = sorted(rows)
    path = scratch_path(spark, "t-csv")
    E.write_csv(df, path)
    back = I.read_csv(spark, path, df.schema).withColumn("retweet_count", F.col("retweet_count").cast("bigint"))
    assert sorted(tuple(r) for r in back.collect()) == want
    for pretty in (False, True):
        path = scratch_path(spark, "t-json")
        E.write_json_array(df.repartition(3), path, pretty)
        assert sorted(tuple(r) for r in I.read_json_array(spark, path, df.schema).collect()) == want
    for codec in ("none", "gzip", "lz4"):
        path = scratch_path(spark, "t-jsonl")
        E.write_json_lines(df, path, codec)
        assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(path).collect()) == want


def test_json_parts_are_arrays(spark, tmp_path):
    import json

    path = str(tmp_path / "arr")
    E.write_json_array(spark.range(50).repartition(4), path)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "arr").glob("part-*")]
    assert sorted(r["id"] for part in parts for r in part) == list(range(50))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.json").write_text('"just text"')
    assert I.read_json_array(spark, str(tmp_path / "other"), POST).count() == 0


def test_json_arrays_are_bounded(spark, tmp_path):
    import json

    for n, max_rows in ((50, 7), (28, 7), (7, 7), (3, 1), (0, 5)):
        path = str(tmp_path / f"arr-{n}-{max_rows}")
        E.write_json_array(spark.range(n).coalesce(1), path, max_rows=max_rows)
        parts = [json.loads(p.read_text()) for p in (tmp_path / f"arr-{n}-{max_rows}").glob("part-*")]
        assert sorted(r["id"] for part in parts for r in part) == list(range(n))
        assert max(len(part) for part in parts) <= max_rows and len(parts) == max(-(-n // max_rows), 1)
        assert I.read_json_array(spark, path, spark.range(1).schema).count() == n


def test_json_array_source_loses_nothing(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        (tmp_path / name / "y.json").write_text('[{"id": "good", "retweet_count": 1}]')
        return sorted(r["id"] for r in I.read_json_array(spark, str(tmp_path / name), POST).collect())

    assert read("array", ' \n[{"id": "a"}, null, {"id": "b"}]') == ["a", "b", "good"]
    for name, text in (("object", '{"id": "a"}'), ("string", '"just text"'), ("null", "null"), ("empty", ""), ("blank", " \n"), ("none", "[]")):
        assert read(name, text) == ["good"]
    for name, text in (("type", '[{"id": "a", "retweet_count": "many"}, {"id": "b"}]'), ("cut", '[{"id": "a"}, {"id": '), ("text", "no json")):
        with pytest.raises(Exception):
            read(name, text)


def test_search_history_keeps_null_queries(spark):
    path = scratch_path(spark, "t-history")
    E.append_search(spark, path, "gold", 20, "Top", 3)
    rows = spark.createDataFrame([(None, 5, "Latest", 0), ("tin", 1, None, 1)], "query string, count int, product string, fetched_count bigint")
    E.append_searches(rows, path)
    E.append_searches(rows.limit(0), path)
    back = [tuple(r)[:4] for r in spark.read.parquet(path).collect()]
    assert sorted(back, key=str) == sorted([("gold", 20, "Top", 3), (None, 5, "Latest", 0), ("tin", 1, None, 1)], key=str)


def test_packing(spark):
    texts = ["x" * 99, "x" * 100, "é" * 50, "", None, 'a "b" c ' * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    for codec in ("zlib", "gzip"):
        packed = K.pack(df, "id", "payload", codec)
        flags = {r["id"]: r["compressed"] for r in packed.collect()}
        assert flags == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True}
        assert {r["id"]: r["payload"] for r in K.unpack(packed, "id").collect()} == dict(enumerate(texts))
        stats = K.pack_stats(packed).first()
        assert (stats["compressed_count"], stats["uncompressed_count"]) == (3, 3)
        assert stats["original_size"] == 100 + 100 + 800
    with pytest.raises(ValueError):
        K.pack(df, "id", "payload", "rar")


def test_fanout_and_history(spark, posts):
    base = scratch_path(spark, "t-fan")
    scored = posts.withColumn("sentiment_label", F.when(F.col("id") == "1", "positive")).withColumn("sentiment_compound", F.lit(0.1))
    paths = E.write_fanout(scored, base)
    assert spark.read.parquet(paths["posts"]).count() == 5
    score = spark.read.parquet(paths["scores"]).collect()
    assert [(r["tweet_id"], r["label"], r["polarity"]) for r in score] == [("1", "positive", None)]
    assert spark.read.parquet(paths["metadata"]).count() >= 2
    history = scratch_path(spark, "t-history")
    for n in (3, 4):
        E.append_search(spark, history, "gold", 10, "Top", n)
    assert sorted(r["fetched_count"] for r in spark.read.parquet(history).collect()) == [3, 4]


def test_paged_ingest(spark):
    pages = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("a", 2, 1), ("c", 2, 2), ("d", 3, 1)], "id string, page int, pos int")
    assert ids(I.paged(pages, 3)) == ["a", "b", "c"] and ids(I.paged(pages, 0)) == ["a"]


def test_stored_shape(posts):
    assert S.stored_posts(posts).schema.names == POST.names


def test_sql_params(spark, posts):
    got = I.sql_with_params(spark, {"t_posts": posts}, "select id from t_posts where lang = ? and id > ?", ["en", "1"])
    assert sorted(ids(got)) == ["2", "5"]


def test_synthetic(spark):
    rows = I.synthetic_posts(spark.range(25), "id", F.lit("2024-01-01 00:00:00").cast("timestamp")).orderBy(F.desc("created_at")).collect()
    assert rows[0]["sentiment_label"] == "positive" and rows[1]["sentiment_label"] == "negative" and rows[3]["sentiment_label"] == "neutral"
    assert rows[1]["created_at"] == "2023-12-31T23:59:00" and rows[10]["text"] == rows[0]["text"]


def test_ties_go_to_the_incoming_row(spark):
    current = spark.createDataFrame([("1", "old", 5), ("2", "old", None)], "id string, text string, seq int")
    incoming = spark.createDataFrame([("1", "new", 5), ("2", "new", None)], "id string, text string, seq int")
    assert {r["text"] for r in S.upsert(current, incoming, ["id"], "seq").collect()} == {"new"}


def test_sharded_upsert_keeps_the_rest(spark, tmp_path):
    from postlake.operators import shards

    path = str(tmp_path / "shards")
    kind = "id string, text string, seq int, shard_key string"
    for rows in ([("1", "a", 1, "2024_Q1"), ("3", "c", 1, "2024_Q2")], [("2", "b", 1, "2024_Q1"), ("1", "a2", 1, "2024_Q1")]):
        shards.upsert_sharded(spark.createDataFrame(rows, kind), path, "seq")
    got = {(r["id"], r["text"], r["shard_key"]) for r in shards.read_sharded(spark, path).collect()}
    assert got == {("1", "a2", "2024_Q1"), ("2", "b", "2024_Q1"), ("3", "c", "2024_Q2")}


def test_result_keys_differ(spark):
    from postlake.functions.marks import result_key

    row = spark.range(1).select(result_key("s", F.lit("a:b"), F.lit("c")).alias("x"), result_key("s", F.lit("a"), F.lit("b:c")).alias("y")).first()
    assert row["x"] != row["y"]


def test_shards_are_swapped_at_once(spark, monkeypatch):
    """A writer that dies before, or loses against another one at, the swap leaves the table as it was."""
    from postlake.operators import shards
    from postlake.session import exists, scratch_path, scratch_scope
    from postlake.sources import versions

    path, kind = scratch_path(spark, "t-swap"), "id string, seq bigint, v string, shard_key string"
    write = lambda *rows: shards.upsert_sharded(spark.createDataFrame(list(rows), kind), path, "seq")
    read = lambda: sorted(map(tuple, shards.read_sharded(spark, path).select("id", "seq", "v", "shard_key").collect()))
    write(("a", 1, "x", "2024_Q1"), ("b", 1, "x", "2024_Q2"))
    before = read()
    with monkeypatch.context() as patch:
        patch.setattr(versions, "_move", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            write(("a", 2, "y", "2024_Q1"), ("c", 2, "y", "2024_Q3"))
    assert read() == before
    with monkeypatch.context() as patch:
        patch.setattr(versions, "latest", lambda spark, path, *_, f=versions.latest: {**f(spark, path), "version": 0})
        with pytest.raises(versions.VersionExists):
            write(("a", 2, "y", "2024_Q1"))
    assert read() == before
    begun = shards.read_sharded(spark, path)
    write(("a", 2, "y", "2024_Q1"), ("c", 2, "y", "2024_Q3"))
    assert read() == [("a", 2, "y", "2024_Q1"), ("b", 1, "x", "2024_Q2"), ("c", 2, "y", "2024_Q3")]
    assert sorted(map(tuple, begun.select("id", "seq", "v", "shard_key").collect())) == before
    one = shards.scan(shards.read_sharded(spark, path), "2024_Q2")
    assert "PartitionFilters: [isnotnull(shard_key" in one._jdf.queryExecution().executedPlan().toString() or "shard_key IN" in one._jdf.queryExecution().executedPlan().toString()
    for n in range(3, 9):
        write(("a", n, "z", "2024_Q1"))
    assert read() == [("a", 8, "z", "2024_Q1"), ("b", 1, "x", "2024_Q2"), ("c", 2, "y", "2024_Q3")]
    assert len(versions._numbers(spark, path)) == versions.KEEP + 1


def test_keyed_table(spark):
    """Many small writes, out of order and repeated, against a dictionary; the levels stay few."""
    import random

    from postlake.operators.stored import FANOUT, KeyedTable
    from postlake.session import exists, scratch_path, scratch_scope
    from postlake.sources import versions

    rnd, kind = random.Random(2), "k string, seq bigint, v int"
    schema = spark.createDataFrame([], kind).schema
    table, want = KeyedTable(spark, scratch_path(spark, "t-keyed"), schema, ["k"], "seq"), {}
    assert table.read().collect() == []
    states = {}
    for txn in range(11):
        rows = {k: (k, rnd.choice([None, txn, txn // 2]), 100 * txn + i) for i, k in enumerate(rnd.sample(["a", "b", "c", None, "d"], 3))}
        table.write(spark.createDataFrame(list(rows.values()), schema), txn)
        table.write(spark.createDataFrame([("a", 99, -1)], schema), txn)  # comes again: skipped
        for k, row in rows.items():
            if k not in want or (row[1] if row[1] is not None else -1) >= (want[k][1] if want[k][1] is not None else -1):
                want[k] = row
        states[txn] = dict(want)
        assert {r.k: tuple(r) for r in table.read().collect()} == want
        if txn:
            assert {r.k: tuple(r) for r in table.read(before_txn=txn).collect()} == states[txn - 1]
    assert len(versions.latest(spark, table.path)["runs"]) < 2 * FANOUT
    table.compact()
    assert {r.k: tuple(r) for r in table.read().collect()} == want
    assert "Window" not in table.read()._jdf.queryExecution().executedPlan().toString()


def test_offset_without_a_limit(spark):
    """All rows behind the offset, in order, and none of them through one task."""
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 13).alias("c")).repartition(6)
    out = S.page(df, F.col("c").desc_nulls_last(), F.col("id").asc(), offset=1_234)
    want = [tuple(r) for r in df.orderBy(F.col("c").desc_nulls_last(), F.col("id").asc()).collect()][1_234:]
    assert [tuple(r) for r in out.collect()] == want
    assert out.rdd.getNumPartitions() > 1
    assert S.page(df, F.col("id").asc(), offset=6_000).collect() == [] and S.page(df, offset=4_990).count() == 10


def test_long_word_lists_are_refused(spark, monkeypatch):
    from postlake.operators import lexicon as L

    words = spark.range(30).select(F.concat(F.lit("w"), "id").alias("token"), F.lit(1.0).alias("valence"), F.lit(None).cast("double").alias("step"), F.lit(False).alias("negation"))
    assert len(L.from_table(words).valences) == 30
    monkeypatch.setattr(L, "MOST_WORDS", 29)
    with pytest.raises(ValueError, match="score_with_table"):
        L.from_table(words)


def test_look_up_reads_few_row_groups(spark, monkeypatch):
    """With a shard only its folder is listed; without one the filters of the id skip the row groups of all shards."""
    monkeypatch.setattr(D, "GROUP_BYTES", 16 << 10)
    rows = spark.range(0, 40_000, 2).select(F.md5(F.col("id").cast("string")).alias("id"), F.concat(F.lit("2024_Q"), (F.col("id") % 4 + 1).cast("string")).alias("shard_key"), F.rand(3).alias("v"))
    path = scratch_path(spark, "t-lookup")
    D.write_sharded(rows, path)
    table = D.read_sharded(spark, path)

    def read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().apply(0)
        return leaf.metrics().apply("numOutputRows").value(), leaf.toString()

    import hashlib

    there, absent = (hashlib.md5(str(i).encode()).hexdigest() for i in (2_000, 2_001))
    n, plan = read(D.lookup(table, there, "2024_Q1"))
    assert D.lookup(table, there, "2024_Q1").count() == 1 and D.lookup(table, there).count() == 1 and D.lookup(table, absent).count() == 0
    assert 0 < n < 5_000 and "PartitionFilters: [isnotnull(shard_key" in plan and f"EqualTo(id,{there})" in plan
    assert read(D.lookup(table, there))[0] < 10_000 and read(D.lookup(table, absent))[0] == 0


def test_scratch_of_a_scope_goes(spark):
    """Folders made inside go at its end, also after an error; inner scopes and folders from before are apart."""
    before = scratch_path(spark, "t-scope")
    with scratch_scope(spark):
        outer = scratch_path(spark, "t-scope")
        spark.range(3).write.parquet(outer)
        with pytest.raises(ValueError), scratch_scope(spark):
            inner, never = scratch_path(spark, "t-scope"), scratch_path(spark, "t-scope")
            spark.range(2).write.parquet(inner)
            raise ValueError
        assert exists(spark, outer) and not exists(spark, inner) and not exists(spark, never)
        spark.read.parquet(outer).write.parquet(before)
    assert not exists(spark, outer) and spark.read.parquet(before).count() == 3
