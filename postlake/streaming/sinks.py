"""Running a stream to its end and keeping micro-batches exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import LongType, StructType

from postlake.session import input_bytes, is_directory, scratch_path

#: Bytes of input for one file of ``write_arrivals``; for one of the first files of each part.
ARRIVAL_BYTES, SMALL_ARRIVAL_BYTES = 128 << 20, 8 << 20
#: How many files of a part may be that small. A file is one scan split, so a micro-batch is read by as many tasks.
SMALL_ARRIVALS = 32


def stream_files(
    spark: SparkSession, path: str, schema: StructType, max_bytes: int = 256 << 30, max_files: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A file stream over a table folder, or over a single table file.

    ``max_bytes`` (or ``max_files``) bounds a micro-batch, and with it what one key can hold in one
    task of a stateful job.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    if is_directory(spark, path):
        return reader.load(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).load(folder)


def write_arrivals(df: DataFrame, by: str | Column, path: str, parts: int = 4) -> int:
    """Write a table as files that a file stream takes up in the order of ``by``; returns how many make one of ``parts``.

    One job writes the ranges of ``by`` at the same time; their files then get modification times in that order, a
    millisecond apart, as a stream goes by those. Rows of one value of ``by`` share a file, and nulls come first. Small
    tables have ``parts`` files, larger ones a multiple of it, as their bytes ask for; an empty one has a file without rows.
    """
    spark, size = df.sparkSession, input_bytes(df) or 0
    each = max(min(size // SMALL_ARRIVAL_BYTES // parts + 1, SMALL_ARRIVALS), size // ARRIVAL_BYTES // parts + 1)
    wanted = parts * each
    df.repartitionByRange(wanted, by).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Names begin with the number of the range.
    files = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = int(time.time() * 1000) - len(files)
    for number, file in enumerate(files):
        fs.setTimes(file, first + number, -1)
    # Rounded down: ranges without rows have no file, and fewer batches than parts would be too few.
    return max(1, len(files) // parts)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Feed every micro-batch to ``write`` until the input known at the start is used up."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch owns its folder and overwrites it when it is run again after a failure."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def collect_stream(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The whole output of a finished stream as a table, with the batch that wrote each row."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    run_batches(stream, batch_writer(path), mode)
    return spark.read.schema(with_batch(stream.schema)).parquet(path)


def with_batch(schema: StructType) -> StructType:
    """Columns of the rows of ``batch_writer`` when they are read back; a stream without a batch gives an empty table."""
    return StructType(list(schema.fields)).add("batch_id", LongType())
