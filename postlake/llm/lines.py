"""Line deduplication by overlapping windows of three lines.

Lines that hold anything are taken without white space at their ends; each three in a row form a window, and a text of
one or two such lines is one window. Equal windows are found across all texts; the first, by (doc_id, place), stays,
and a line goes if any later occurrence covers it. Blank lines stay where they are; a text that loses all its other
lines becomes empty.

Defined results: null and empty texts have no line and stay as they are; rows that are equal in doc_id and text are one
document, so they do not remove each other; a null doc_id comes after all others; an empty table gives an empty table;
input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlake.llm.arrow import batch_of, map_slices
from postlake.session import scratch_path

WINDOW = 3
_BLANKS = " \t\r"


def content_lines(text: Column) -> Column:
    """The lines that hold anything, trimmed."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)))
    return F.filter(trimmed, lambda line: line != "")


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: key of the document, place of the window's first line, 128-bit digest of its lines."""
    lines = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_row"), content_lines(F.col(text)).alias("lines"))
    n = F.size("lines")
    digest = lambda j: F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", j + 1, WINDOW))))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), digest)
    return lines.filter(n > 0).select("_id", "_row", F.posexplode(each).alias("place", "window"))


def later_windows(spark, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document with any: the places of windows that occurred before."""
    path = scratch_path(spark, "line-windows")
    windows(docs, doc_id, text).write.parquet(path)
    every = spark.read.parquet(path)
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row", "place")
    first = every.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("window", "first")
    # Written, so that the join can split the rows of a window that is everywhere: a fresh read brings no order of its own.
    repeated = scratch_path(spark, "line-repeated")
    first.write.parquet(repeated)
    joined = every.join(spark.read.parquet(repeated), "window")
    return joined.filter(place != F.col("first")).groupBy("_id", "_row").agg(F.collect_set("place").alias("later"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines removed from ``text``, and n_lines, n_removed (lines that hold anything)."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_id", "_row", "_later")]
    later = later_windows(docs.sparkSession, docs, doc_id, text).withColumnRenamed("later", "_later")
    keyed = docs.select(*kept, F.xxhash64(text).alias("_text_row"))
    on = keyed[doc_id].eqNullSafe(later["_id"]) & (keyed["_text_row"] == later["_row"])
    joined = keyed.join(later, on, "left").select(*kept, "_later")
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])

    def make():
        def step(part: pa.RecordBatch):
            texts, n_lines, n_removed = [], [], []
            for value, places in zip(part.column(text).to_pylist(), part.column("_later").to_pylist(), strict=True):
                value, n, gone = strip(value, places)
                texts.append(value)
                n_lines.append(n)
                n_removed.append(gone)
            yield batch_of(schema, {c: part.column(c) for c in kept} | {text: pa.array(texts, pa.large_string()), "n_lines": n_lines, "n_removed": n_removed})

        return step

    return map_slices(joined, text, schema, make)


def strip(value: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the covered lines, its lines that hold anything, and how many of them went."""
    lines = (value or "").split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(_BLANKS)]
    if not places:
        return value, len(full), 0
    change = np.zeros(len(full) + 1, np.int64)
    starts = np.array(places)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + WINDOW, len(full)), -1)
    gone = {full[i] for i in np.flatnonzero(np.cumsum(change[:-1])).tolist()}
    if len(gone) == len(full):
        return "", len(full), len(gone)
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(full), len(gone)
