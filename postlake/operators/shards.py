"""Calendar shards: the partitioned table, its statistics and queries across shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from postlake.functions.periods import shard_key
from postlake.operators.store import upsert
from postlake.session import exists
from postlake.sources import versions

SHARD = "shard_key"


def with_shard(posts: DataFrame, shards_per_year: int = 4) -> DataFrame:
    return posts.withColumn(SHARD, shard_key("created_at", "id", shards_per_year))


#: Bytes of a row group: what a look-up reads at least of each file that may hold the id.
GROUP_BYTES = 32 << 20


def write_sharded(posts: DataFrame, path: str, mode: str = "append", key: str = "id") -> None:
    """One folder per shard; rows are added. The rebalance hint lets AQE give a large shard many writers.

    Rows are sorted by ``key`` inside a file and row groups carry a Bloom filter of it, so a look-up by key skips the
    files and row groups that do not hold it. ``overwrite`` replaces the shards that ``posts`` touches, with all their
    rows; see ``upsert_sharded`` to keep the others.
    """
    dealt = posts.hint("rebalance", SHARD)
    if key in posts.columns:
        dealt = dealt.sortWithinPartitions(SHARD, key)
    (
        dealt.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option(f"parquet.bloom.filter.enabled#{key}", True).option("parquet.bloom.filter.adaptive.enabled", True)
        .option("parquet.block.size", GROUP_BYTES)
        .partitionBy(SHARD)
        .parquet(path)
    )


def upsert_sharded(posts: DataFrame, path: str, seq: str, key: str = "id") -> None:
    """Write posts over the stored ones of the same shard and id; all other rows stay.

    Only touched shards are read, and their merged rows are written once, into a folder of their own; the list of
    folders that count is then replaced in one step. A job that breaks off leaves the table as it was, and readers see
    the old version or the new one. A post whose date moves it to another shard is a new row there; the row in its old
    shard stays.
    """
    spark, path = posts.sparkSession, path.rstrip("/")
    before = versions.latest(spark, path)
    if before is None and exists(spark, path):
        raise ValueError(f"{path} is a table without versions")
    stored = posts.limit(0) if before is None else read_sharded(spark, path)
    touched = posts.select(SHARD).distinct()
    folder = versions.data_folder()
    merged = upsert(stored.join(touched, SHARD, "left_semi"), posts, [SHARD, key], seq)
    write_sharded(merged, f"{path}/{folder}", key=key)
    shards = {**(before["shards"] if before else {}), **{s: f"{folder}/{SHARD}={s}" for s in _shards_in(spark, f"{path}/{folder}")}}
    number = before["version"] + 1 if before else 1
    versions.commit(spark, path, {"version": number, "shards": shards, "folders": sorted({f.rsplit("/", 1)[0] for f in shards.values()})})


def _shards_in(spark: SparkSession, path: str) -> list[str]:
    """The shards of a partitioned folder, by the names of its folders."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)]
    return sorted(n.removeprefix(f"{SHARD}=") for n in names if n.startswith(f"{SHARD}="))


def read_sharded(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The newest version of a table, or a plain partitioned folder. The shard column is part of the folder name and stays text."""
    reader, path = spark.read, path.rstrip("/")
    found = versions.latest(spark, path)
    if schema is not None:
        fields = [*schema.fields, T.StructField(SHARD, T.StringType())]
        reader = reader.schema(T.StructType([*fields, T.StructField(versions.PART, T.StringType())] if found else fields))
    if found is None:
        return reader.parquet(path)
    return reader.option("basePath", f"{path}/data").parquet(*[f"{path}/{f}" for f in found["shards"].values()]).drop(versions.PART)


def scan(table: DataFrame, *shards: str) -> DataFrame:
    """Only the named shards; on a partitioned table the others are not even listed."""
    return table.filter(F.col(SHARD).isin(list(shards)))


def shard_names(start: str, end: str, shards_per_year: int = 4) -> list[str]:
    """Every shard between two ISO dates, worked out from year and month alone."""
    (y0, m0), (y1, m1) = ((int(d[:4]), int(d[5:7])) for d in (start, end))
    months = range(y0 * 12 + m0 - 1, y1 * 12 + m1) if start <= end else ()
    names = set()
    for month_index in months:
        year, month = divmod(month_index, 12)
        if shards_per_year == 4:
            names.add(f"{year}_Q{month // 3 + 1}")
        elif shards_per_year == 12:
            names.add(f"{year}_{month + 1:02d}")
        else:
            names.add(f"{year}_S{month * shards_per_year // 12 + 1:02d}")
    return sorted(names)


def scan_range(table: DataFrame, start: str, end: str, shards_per_year: int = 4) -> DataFrame:
    """All rows of the shards a range touches; no filter inside the shards."""
    return scan(table, *shard_names(start, end, shards_per_year))


def top_per_shard(table: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy(SHARD).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def union_shards(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def summary(table: DataFrame) -> DataFrame:
    return table.groupBy(SHARD).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("min_date"), F.max("created_at").alias("max_date")
    )


def languages(table: DataFrame) -> DataFrame:
    return table.groupBy(SHARD, "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(SHARD, F.desc("n"), "lang")


def labels(table: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows per shard and score label."""
    keys = table.select("id", SHARD)
    joined = scores.select("tweet_id", "label").join(keys, F.col("tweet_id") == F.col("id"))
    return joined.groupBy(SHARD, "label").agg(F.count(F.lit(1)).alias("n"))


def totals(table: DataFrame) -> DataFrame:
    """Per shard and over all; the roll-up runs on the per-shard rows, not on the posts."""
    per_shard = table.groupBy(SHARD).agg(F.count(F.lit(1)).alias("n"))
    rolled = per_shard.rollup(SHARD).agg(F.sum("n").alias("n"), F.grouping(SHARD).cast("int").alias("is_total"))
    return rolled.select(F.coalesce(SHARD, F.lit("(all)")).alias(SHARD), "is_total", "n")


def placement(posts: DataFrame, shards_per_year: int = 4) -> DataFrame:
    return with_shard(posts, shards_per_year).groupBy(SHARD).agg(F.count(F.lit(1)).alias("n"))


def lookup(table: DataFrame, post_id: str, shard: str | None = None) -> DataFrame:
    """One post: only the named shard is listed, and without one only row groups whose filter knows the id are read."""
    return (table if shard is None else scan(table, shard)).filter(F.col("id") == post_id)


def lookup_with_sentiment(table: DataFrame, scores: DataFrame, shard: str | None, post_id: str) -> DataFrame:
    """One post with its score columns; both sides are cut to the id before they meet."""
    one = lookup(table, post_id, shard)
    score = scores.filter(F.col("tweet_id") == post_id)
    return one.join(score, one["id"] == score["tweet_id"], "left").drop("tweet_id")


