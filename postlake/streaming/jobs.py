"""The streaming jobs. Each one ends with its input (``availableNow``) and returns its sink."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from postlake.operators.limits import replay
from postlake.operators.scoring import score
from postlake.operators.store import keep_last, row_digest
from postlake.operators.stored import KeyedTable
from postlake.sources.export import CSV_OPTIONS
from postlake.session import remove, scratch_path
from postlake.streaming.sinks import batch_writer, collect_stream, run_batches, with_batch


def window_usage(stream: DataFrame, key: str, ts: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Requests per key and window. Update mode, so windows still open at the end are kept too."""
    counts = (
        stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("used"))
        .select(F.col("w.start").alias("window_start"), key, "used")
    )
    updates = collect_stream(counts, "usage", mode="update")
    return updates.groupBy("window_start", key).agg(F.max_by("used", "batch_id").alias("used"))


def _limit(limits: dict[str, tuple[float, float]] | tuple[float, float], key: str) -> tuple[Column, Column]:
    """Capacity and rate; a key that has none gets null and is not limited."""
    if isinstance(limits, tuple):
        return F.lit(float(limits[0])), F.lit(float(limits[1]))
    return tuple(F.try_element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v[i]))]), F.col(key)) for i in (0, 1))


class _Buckets:
    """The buckets that a stream's micro-batches leave to each other: one row per key, in a stored table."""

    def __init__(self, stream: DataFrame, keys: Sequence[str], label: str):
        fields = [stream.schema[k] for k in keys]
        kept = [StructField("tokens_left", DoubleType()), StructField("last_refill", LongType()), StructField("batch", LongType())]
        self.table = KeyedTable(stream.sparkSession, scratch_path(stream.sparkSession, label), StructType([*fields, *kept]), keys, "batch")
        self.keys = list(keys)

    def of(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """What earlier batches have left for the keys of this one; null keys are not kept apart from the others."""
        own = batch.select(*[F.col(k).alias(f"_own_{k}") for k in self.keys]).distinct()
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in self.keys])
        return self.table.read(before_txn=batch_id).join(own, same, "left_semi").select(*self.keys, "tokens_left", "last_refill")

    def keep(self, decided: DataFrame, tokens: str, last: str, at: str, order_id: str, batch_id: int) -> None:
        latest = F.max_by(F.struct(F.col(tokens).alias("tokens_left"), F.col(last).alias("last_refill")), F.struct(at, order_id))
        left = decided.groupBy(*self.keys).agg(latest.alias("_left")).select(*self.keys, "_left.*", F.lit(batch_id).cast("bigint").alias("batch"))
        self.table.write(left, batch_id)


def token_bucket(
    stream: DataFrame, keys: Sequence[str], ts_us: str, order_id: str, limits: dict[str, tuple[float, float]] | tuple[float, float],
    interval_s: float = 1.0, max_wait_s: float = 0.0, carry: Sequence[str] = (), name: str = "allowed",
) -> DataFrame:
    """Decide requests as they arrive; each request leaves with the micro-batch that has it (``batch_id``).

    A micro-batch is replayed like a log (``limits.replay``), so a key that fills it is cut over many tasks; per key only
    (tokens, last refill) is kept, in a stored table. ``limits`` is (capacity, tokens per interval), or one such pair per
    value of the last key column; a key without one is not limited. Input files have to arrive in time order: a row
    older than the last refill is judged without one.
    """
    columns = [*dict.fromkeys([*keys, order_id, ts_us, *carry])]
    buckets, path = _Buckets(stream, keys, "buckets"), scratch_path(stream.sparkSession, "decided")
    limit = _limit(limits, keys[-1])

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select(*columns)
        done = replay(asked, keys, ts_us, order_id, *limit, interval_s, max_wait_s, kept=buckets.of(asked, batch_id))
        batch_writer(path)(done.withColumnRenamed("allowed", name), batch_id)
        buckets.keep(done.sparkSession.read.schema(schema).parquet(f"{path}/batch_id={batch_id}"), "tokens_left", "last_refill", ts_us, order_id, batch_id)

    added = [(name, IntegerType()), ("delay_s", DoubleType()), ("tokens_left", DoubleType()), ("last_refill", LongType())]
    schema = StructType([*[stream.schema[c] for c in columns], *[StructField(n, t) for n, t in added]])
    run_batches(stream, write)
    return stream.sparkSession.read.schema(with_batch(schema)).parquet(path).drop("tokens_left", "last_refill")


def two_buckets(
    stream: DataFrame, own_keys: Sequence[str], app_keys: Sequence[str], ts_us: str, order_id: str,
    own_limits, app_limits, interval_s: float = 1.0, names: tuple[str, str] = ("endpoint", "app"),
) -> DataFrame:
    """Two buckets for every request, both charged even if one denies, decided together in its micro-batch.

    What the first bucket decides is written before the second one reads it: dealing rows out by range reads them twice,
    and would decide them twice.
    """
    spark, columns = stream.sparkSession, [*dict.fromkeys([*own_keys, *app_keys, order_id, ts_us])]
    path, once = scratch_path(spark, "decided-twice"), scratch_path(spark, "decided-once")
    kept = [_Buckets(stream, k, f"{n}-buckets") for k, n in zip((own_keys, app_keys), names, strict=True)]
    limits = _limit(own_limits, own_keys[-1]), _limit(app_limits, app_keys[-1])
    added = [StructField(f"{n}_{c}", t) for n in names for c, t in (("allowed", IntegerType()), ("tokens", DoubleType()), ("last", LongType()))]
    schema = StructType([*[stream.schema[c] for c in columns], *added])

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.select(*columns)
        for n, keys, bucket, limit, to in zip(names, (own_keys, app_keys), kept, limits, (once, path), strict=True):
            done = replay(done, keys, ts_us, order_id, *limit, interval_s, kept=bucket.of(done, batch_id)).drop("delay_s")
            done = done.withColumnsRenamed({"allowed": f"{n}_allowed", "tokens_left": f"{n}_tokens", "last_refill": f"{n}_last"})
            fields = [f for f in schema if f.name in done.columns]
            batch_writer(to)(done.select(*[f.name for f in fields]), batch_id)
            done = batch.sparkSession.read.schema(StructType(fields)).parquet(f"{to}/batch_id={batch_id}")
        for n, bucket in zip(names, kept, strict=True):
            bucket.keep(done, f"{n}_tokens", f"{n}_last", ts_us, order_id, batch_id)
        remove(spark, f"{once}/batch_id={batch_id}")

    run_batches(stream, write)
    out = spark.read.schema(with_batch(schema)).parquet(path)
    both = F.col(f"{names[0]}_allowed") * F.col(f"{names[1]}_allowed")
    return out.select(*columns, *[f"{n}_allowed" for n in names], both.alias("allowed"), "batch_id")


def score_stream(stream: DataFrame, method: str = "vader", lexicon=None) -> DataFrame:
    """Scoring is a projection, so the streaming plan is the batch plan and holds no state."""
    return collect_stream(score(stream, method, lexicon=lexicon), "scored")


def bounded_intake(stream: DataFrame, arrival: str, order: str, cap: int) -> DataFrame:
    """Every row that arrives, with ``admitted``: 1 for the first ``cap`` of each arrival, by ``order``.

    An arrival (one filling of the queue) may be spread over micro-batches: each gives out, by
    ``order``, the places that earlier ones have left. ``order`` has to be unique in an arrival; rows
    without one are turned away. Places are given out on (arrival, order) alone, cut down by rank
    before the shuffle, and kept as one row per arrival and batch; whole rows are only compared with
    the last place given.
    """
    spark = stream.sparkSession
    path, places = scratch_path(spark, "intake"), scratch_path(spark, "intake-places")

    def write(batch: DataFrame, batch_id: int) -> None:
        rank = F.row_number().over(Window.partitionBy("_arrival").orderBy("_order"))
        asked = batch.filter(F.col(order).isNotNull()).select(F.col(arrival).alias("_arrival"), F.col(order).alias("_order"))
        placed = asked.withColumn("_rank", rank).filter(F.col("_rank") <= cap)
        kept = placed.groupBy("_arrival").agg(F.max("_order").alias("_last"), F.count("*").alias("_given")).schema
        if batch_id:
            # A batch that is run again sees the same earlier ones.
            before = spark.read.schema(with_batch(kept)).parquet(places).filter(F.col("batch_id") < batch_id)
            used = before.groupBy(F.col("_arrival").alias("_known")).agg(F.sum("_given").alias("_used"))
            placed = placed.join(used, F.col("_arrival").eqNullSafe(F.col("_known")), "left")
            placed = placed.filter(F.col("_rank") <= cap - F.coalesce("_used", F.lit(0)))
        batch_writer(places)(placed.groupBy("_arrival").agg(F.max("_order").alias("_last"), F.count("*").alias("_given")), batch_id)
        last = spark.read.schema(kept).parquet(f"{places}/batch_id={batch_id}").drop("_given")
        admitted = F.coalesce(F.col(order) <= F.col("_last"), F.lit(False)).cast("int")
        judged = batch.join(last, F.col(arrival).eqNullSafe(F.col("_arrival")), "left")
        batch_writer(path)(judged.select(*batch.columns, admitted.alias("admitted")), batch_id)

    run_batches(stream, write)
    schema = StructType([*stream.schema.fields, StructField("admitted", IntegerType())])
    return stream.sparkSession.read.schema(with_batch(schema)).parquet(path).drop("batch_id")


def dedup(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """One row of every id, the earliest of the first micro-batch that has it; a null id is an id like any other.

    Ids that have been seen are kept in a stored table, one small run per micro-batch, and never forgotten, however far
    event time has moved on. A micro-batch looks its ids up by a join on the id alone; the engine's runtime Bloom filter
    cuts a long table to the ids that may match before anything is shuffled.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "dedup")
    kept = StructType([StructField("_id", stream.schema[key].dataType), StructField("_batch", LongType())])
    seen = KeyedTable(spark, scratch_path(spark, "dedup-ids"), kept, ["_id"], "_batch")

    def write(batch: DataFrame, batch_id: int) -> None:
        first = keep_last(batch, [key], [F.asc_nulls_last(ts), F.desc(row_digest(batch))])
        known = seen.read(before_txn=batch_id).select("_id")
        batch_writer(path)(first.join(known, F.col(key).eqNullSafe(F.col("_id")), "left_anti"), batch_id)
        written = spark.read.schema(stream.schema).parquet(f"{path}/batch_id={batch_id}")
        seen.write(written.select(F.col(key).alias("_id"), F.lit(batch_id).cast("bigint").alias("_batch")), batch_id)

    run_batches(stream, write)
    return spark.read.schema(with_batch(stream.schema)).parquet(path).drop("batch_id")


def export(stream: DataFrame, fmt: str = "json") -> str:
    """Continuous export through the file sink, whose commit log makes it exactly once."""
    spark = stream.sparkSession
    path = scratch_path(spark, f"export-{fmt}")
    writer = (
        stream.writeStream.outputMode("append").format(fmt).option("path", path)
        .option("checkpointLocation", scratch_path(spark, "export-checkpoint"))
    )
    options = CSV_OPTIONS if fmt == "csv" else {"ignoreNullFields": False}
    writer.options(**options).trigger(availableNow=True).start().awaitTermination()
    return path


def upsert(stream: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Continuous upsert into a stored table; a micro-batch writes its last rows once, and the result is a plain scan.

    Of rows with one ``seq`` the later micro-batch wins. A batch that is run again is not written twice.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, scratch_path(spark, "upsert"), stream.schema, keys, seq)
    run_batches(stream, table.write)
    table.compact()
    return table.read()
