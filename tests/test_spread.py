"""A large table is dealt out when one scan split holds much of it."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from postlake import session


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    monkeypatch.setattr(session, "SPLIT_BYTES", 100_000, raising=False)
    monkeypatch.setattr(session, "LARGE_PIECE_BYTES", 20_000, raising=False)
    table = pa.table({"id": list(range(5000)), "text": [os.urandom(50).hex() for _ in range(5000)]})
    pq.write_table(table, tmp_path / "one.parquet")
    one = spark.read.parquet(str(tmp_path / "one.parquet"))
    dealt = session.spread(one)
    assert sorted(r["id"] for r in dealt.collect()) == list(range(5000)) and dealt.columns == one.columns
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000
    # Fine splits stay as they are.
    (tmp_path / "many").mkdir()
    for i in range(40):
        pq.write_table(table.slice(i * 125, 125), tmp_path / "many" / f"{i}.parquet")
    monkeypatch.setattr(session, "SPLIT_BYTES", 600_000, raising=False)
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many) is many


def test_a_derived_word_list_is_broadcast(spark):
    from postlake.operators import scoring

    words = spark.range(3000).groupBy((F.col("id") % 3).alias("n")).count().select(
        F.concat(F.lit("w"), "n").alias("token"), F.lit(0.5).alias("valence"), F.lit(None).cast("double").alias("step"),
        F.lit(None).cast("boolean").alias("negation"),
    )
    texts = spark.createDataFrame([("1", "w0 and w1"), ("2", None), ("3", "")], "id string, text string").repartition(2)
    scored = scoring.score_with_table(texts, words, "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # Nothing is split below the shuffle of the texts.
    optimized = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not any("split(" in line for line in optimized.partition("RepartitionByExpression")[2].splitlines()[1:2])
    assert sorted((r["id"], r["label"]) for r in scored.collect()) == [("1", "positive"), ("2", "neutral"), ("3", "neutral")]
