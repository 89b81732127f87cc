"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.session import input_bytes, scratch_path

#: Bytes of tables for one task at the end of a step that only joins, counts or compares.
LIGHT_BYTES = 8 << 20
#: Rounds after which an unfinished graph is an error; rounds grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_light(df: DataFrame, label: str) -> DataFrame:
    """Like ``stored``, for steps that only join, count or compare: over small tables few tasks do the last part.

    A search takes many such steps, and the driver keeps a record of every task. Tasks follow the bytes of the tables, one
    per core at least; where these ask for as many as a shuffle has, the step is left as it is.
    """
    spark, size = df.sparkSession, input_bytes(df)
    wanted = None if size is None else max(spark.sparkContext.defaultParallelism, size // LIGHT_BYTES + 1)
    few = wanted is not None and wanted < int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.coalesce(wanted) if few else df, label)


def _moved(around: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """A node's larger (smaller) neighbours move to the least one around it; a small star also keeps the node itself."""
    near = F.least("u", "m") if large else F.col("m")
    linked = around.join(least.select("u", "m"), "u").select("u", "v", near.alias("m"))
    moved = linked.filter("v > u" if large else "v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> one row (node, component) per linked node; the component is its least node."""
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored_light(edges, "links")
    for _ in range(MOST_ROUNDS):
        # edges (u, v), v < u, one row each
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored_light(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        # All are stars once no node has both a smaller neighbour and another one.
        if least.filter("m < u and n > 1").isEmpty():
            root = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root.select("node", F.col("node").alias("component")))
        # Never more rows than edges; what comes several times is made one by the small star.
        larger = stored_light(_moved(around, least, True), "large-star")
        least = stored_light(larger.groupBy("u").agg(F.min("v").alias("m")), "least")
        edges = stored_light(_moved(larger, least, False).distinct(), "small-star")
    raise RuntimeError("components did not settle")
