"""What a task holds stays bounded when a table grows."""

import json

from pyspark.sql import functions as F

from postlake.sources import export as E, ingest as I


def test_json_arrays_are_bounded_by_bytes(spark, tmp_path):
    rows = spark.range(60).select("id", F.repeat(F.lit("é\n"), 50_000 + F.col("id").cast("int")).alias("text"))
    huge = rows.limit(1).select((F.col("id") + 60).alias("id"), F.repeat(F.lit("x"), 3 * E.ARRAY_BYTES).alias("text"))
    every = rows.unionByName(huge).coalesce(1)
    for pretty in (False, True):
        path = tmp_path / f"arr-{pretty}"
        E.write_json_array(every, str(path), pretty)
        parts = [p.read_text() for p in path.glob("part-*")]
        found = [json.loads(p) for p in parts]
        assert sorted(r["id"] for part in found for r in part) == list(range(61))
        assert all(len(p.encode()) < E.ARRAY_BYTES + 1000 for p, f in zip(parts, found, strict=True) if len(f) > 1)
        back = I.read_json_array(spark, str(path), every.schema)
        assert back.exceptAll(every).count() == 0 and every.exceptAll(back).count() == 0


def test_packing_holds_few_payloads_at_a_time():
    import pyarrow as pa

    from postlake.functions import packing as K

    texts = ["x" * 300_000] * 40 + [None, "", "y" * (3 * K.PART_BYTES)] + ["é" * 1000] * 40
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "payload": texts})
    parts = list(K._parts([batch.slice(0, 50), batch.slice(50)], "payload"))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    sizes = [[len((t or "").encode()) for t in p.column("payload").to_pylist()] for p in parts]
    assert all(sum(s) <= K.PART_BYTES or len(s) == 1 for s in sizes)


def test_a_graph_of_few_links_takes_few_tasks(spark):
    from postlake.llm.components import components

    # A star, a path and a ring: with many shuffle partitions a small graph still costs the driver few task records.
    pairs = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 25) for i in range(25)]
    links = spark.createDataFrame(pairs, "a long, b long")
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("few-links", "few links")
        found = {r.node: r.component for r in components(links).collect()}
        jobs = tracker.getJobIdsForGroup("few-links")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {n: 100 * (n // 100) for pair in pairs for n in pair}
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 2500, tasks
