"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL_BASE: dict[str, str] = {}
#: Open scratch scopes, the innermost last, with the paths given out in each.
_SCOPES: list[list[str]] = []


def local_session(app: str = "postlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """All wall-clock rules are stated in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        base = configured
    else:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _LOCAL_BASE.get(context.applicationId)
        if base is None:
            base = _LOCAL_BASE[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten in place."""
    path = f"{shared_base(spark)}/postlake/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders made inside once it ends, also by an error.

    Whatever is built inside has to be written, to a path from before the scope, when the scope ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; one that was never written is no error."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder on whichever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(jpath).isDirectory()


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` is made of, each counted once; None where one of them does not know its size.

    Estimates behind a join multiply and may be far too large, so only the leaves of the plan are asked.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = (leaves.apply(i) for i in range(leaves.size()))
    sizes = {leaf.canonicalized().hashCode(): int(str(leaf.stats().sizeInBytes())) for leaf in found}
    return None if any(x >= 1 << 60 for x in sizes.values()) else sum(sizes.values())


#: Tables below this size are dealt out in small pieces for heavy text work.
SPREAD_BYTES, PIECE_BYTES = 256 << 20, 1 << 20
#: Larger ones are dealt out, in larger pieces, if one scan split of theirs holds more than this.
SPLIT_BYTES, LARGE_PIECE_BYTES = 128 << 20, 8 << 20


def spread_pieces(df: DataFrame) -> int | None:
    """In how many pieces a table is dealt out; None for a large one whose scan splits are fine enough.

    A row group is one scan split whatever its size, and a file may be one row group. The answer depends on the bytes and
    on the rows of each split, which are counted without reading a column; not on the cluster.
    """
    size = input_bytes(df)
    if size is None:
        return None
    if size <= SPREAD_BYTES:
        return size // PIECE_BYTES + 1
    rows = df.groupBy(F.spark_partition_id().alias("split")).count()
    largest, total = rows.agg(F.max("count"), F.sum("count")).first()
    return size // LARGE_PIECE_BYTES + 1 if total and largest * size > SPLIT_BYTES * total else None


def spread(df: DataFrame) -> DataFrame:
    pieces = spread_pieces(df)
    if pieces is None:
        return df
    # Dealt out by row number: rows without a key would be sorted first, a whole row group in one task.
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(pieces, "_row").drop("_row")
