"""Size estimate as an expression, and packing of payloads as a table job."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.text import Col, _col

#: Smallest payload worth packing, in UTF-8 bytes, and the packing level.
PACK_THRESHOLD, POST_PACK_THRESHOLD, LEVEL = 100, 200, 6
#: Bytes of payload that are packed, or unpacked, at a time.
PART_BYTES = 2 << 20

_PACK: dict[str, Callable[[bytes], bytes]] = {
    "zlib": lambda raw: zlib.compress(raw, LEVEL),
    "gzip": lambda raw: gzip.compress(raw, LEVEL, mtime=0),
}
_UNPACK: dict[str, Callable[[bytes], bytes]] = {"zlib": zlib.decompress, "gzip": gzip.decompress}


def _share(text: Column, char: str) -> Column:
    size = F.length(text)
    kept = F.length(F.replace(text, F.lit(char), F.lit("")))
    return F.coalesce(F.try_divide((size - kept).cast("double"), size.cast("double")), F.lit(0.0))


def estimated_ratio(payload: Col, threshold: int = PACK_THRESHOLD) -> Column:
    text = _col(payload)
    guess = F.lit(1.5) + _share(text, '"') * 2 + _share(text, " ") * 2
    return F.when(F.octet_length(text) < threshold, 1.0).otherwise(F.least(guess, F.lit(10.0)))


def estimate(payload: Col, threshold: int = PACK_THRESHOLD) -> list[Column]:
    size = F.octet_length(_col(payload)).cast("bigint")
    expected = estimated_ratio(payload, threshold)
    packed = F.floor(size / expected).cast("bigint")
    return [
        size.alias("original_size"),
        F.round(expected, 6).alias("estimated_ratio"),
        packed.alias("estimated_size"),
        F.round(1 - F.coalesce(F.try_divide(packed.cast("double"), size.cast("double")), F.lit(1.0)), 6).alias(
            "estimated_savings"
        ),
    ]


def _parts(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows of the batches with at most ``PART_BYTES`` of a column together, or one row: a batch is bounded by rows alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            held = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, held + PART_BYTES, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def pack(df: DataFrame, key: str, payload: str, codec: str = "zlib", threshold: int = PACK_THRESHOLD) -> DataFrame:
    """One packed row per input row, part by part inside each partition; nothing is shuffled."""
    if codec not in _PACK:
        raise ValueError(f"unknown codec: {codec}")
    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, compressed boolean, codec string, original_size bigint, compressed_size bigint, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = _PACK[codec]
        for part in _parts(batches, payload):
            raw = [None if t is None else t.encode("utf-8") for t in part.column(payload).to_pylist()]
            big = [r is not None and len(r) >= threshold for r in raw]
            body = [squeeze(r) if b else r for r, b in zip(raw, big)]
            columns = {
                key: part.column(key),
                "compressed": pa.array(big, pa.bool_()),
                "codec": pa.array([codec if b else "none" for b in big], pa.string()),
                "original_size": pa.array([0 if r is None else len(r) for r in raw], pa.int64()),
                "compressed_size": pa.array([0 if b is None else len(b) for b in body], pa.int64()),
                "body": pa.array(body, pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(key, payload).mapInArrow(run, schema)


def unpack(packed: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    key_type = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "body"):
            texts = []
            for body, codec in zip(part.column("body").to_pylist(), part.column("codec").to_pylist(), strict=True):
                opened = _UNPACK[codec](body) if body is not None and codec in _UNPACK else body
                texts.append(None if opened is None else opened.decode("utf-8"))
            yield pa.RecordBatch.from_pydict({key: part.column(key), payload: pa.array(texts, pa.string())})

    return packed.select(key, "codec", "body").mapInArrow(run, f"{key} {key_type}, {payload} string")


def pack_stats(packed: DataFrame) -> DataFrame:
    """Roll-up of a packed table; only rows that were really packed count in the sizes."""
    size = F.sum(F.when(F.col("compressed"), F.col("original_size"))).alias("original_size")
    small = F.sum(F.when(F.col("compressed"), F.col("compressed_size"))).alias("compressed_size")
    base = packed.agg(
        F.coalesce(F.sum(F.col("compressed").cast("bigint")), F.lit(0)).alias("compressed_count"),
        F.count(F.lit(1)).alias("total_processed"),
        F.coalesce(size, F.lit(0)).alias("original_size"),
        F.coalesce(small, F.lit(0)).alias("compressed_size"),
    )
    return base.select(
        "compressed_count",
        (F.col("total_processed") - F.col("compressed_count")).alias("uncompressed_count"),
        "total_processed",
        F.coalesce(F.try_divide(F.col("compressed_count").cast("double"), F.col("total_processed")), F.lit(0.0)).alias(
            "compression_rate"
        ),
        "original_size",
        "compressed_size",
        F.coalesce(
            1 - F.try_divide(F.col("compressed_size").cast("double"), F.col("original_size")), F.lit(0.0)
        ).alias("space_savings"),
        F.coalesce(F.try_divide(F.col("original_size").cast("double"), F.col("compressed_size")), F.lit(1.0)).alias(
            "avg_compression_ratio"
        ),
    )


def size_reduction(packed: DataFrame) -> DataFrame:
    """Average percentage saved per codec over the rows it packed."""
    saved = (1 - F.col("compressed_size") / F.col("original_size")) * 100
    return packed.filter("compressed").groupBy("codec").agg(
        F.count(F.lit(1)).alias("n"), F.avg(saved).alias("avg_reduction_percent")
    )
