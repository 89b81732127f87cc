"""Records of CSV files that may hold line ends in quotes, read by many tasks.

A file is read in byte ranges, whose lines say by themselves neither whether the first of them is inside quotes nor
where records begin. So each range is read for both cases: a line maps "outside" and "inside" to what holds at its end,
and so does a whole range. Ranges are composed in order of their file, one small row each, and then every range is cut
into records from what is known at its beginning. A record that crosses ranges is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BLOCK = [T.StructField("file", T.StringType()), T.StructField("block", T.LongType())]
#: Of a range: what holds at its end for either beginning, and whether a record that is open before it ends in it.
_RANGE = T.StructType([*_BLOCK, *[T.StructField(c, T.BooleanType()) for c in ("out_end", "in_end", "in_closes")]])
#: Of a range: whether it begins inside a record, in which range that one began, and whether the last record is open.
_ENTRY = T.StructType([*_BLOCK, T.StructField("inside", T.BooleanType()), T.StructField("owner", T.LongType()), T.StructField("open_end", T.BooleanType())])
#: A record, or a piece of one: ``owner`` is the range where the record begins, null for a whole record.
_PIECE = T.StructType([*_BLOCK, T.StructField("owner", T.LongType()), T.StructField("text", T.StringType())])


def ends_inside(line: str, inside: bool, comma: str = ",", quote: str = '"') -> bool:
    """Whether a line ends inside quotes. A quote opens at the beginning of a field only and is doubled inside one."""
    i = 0
    while True:
        if not inside and line.startswith(quote, i):
            inside, i = True, i + 1
        if inside:
            while True:
                i = line.find(quote, i)
                if i < 0:
                    return True
                if not line.startswith(quote, i + 1):
                    break
                i += 2
            inside = False
        i = line.find(comma, i)
        if i < 0:
            return False
        i += 1


def _steps(lines: list[str], has: list[bool]) -> tuple[list[bool], list[bool]]:
    """Per line what holds at its end, begun outside and begun inside; lines without a quote change nothing."""
    return (
        [ends_inside(x, False) if q else False for x, q in zip(lines, has, strict=True)],
        [ends_inside(x, True) if q else True for x, q in zip(lines, has, strict=True)],
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.RecordBatch]]:
    """Parts of batches that lie in one range: file, range, whether the range begins, and the rows."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        blocks, files = np.asarray(batch.column("block")), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, n], strict=True):
            at = batch.column("file")[int(lo)].as_py(), int(blocks[lo])
            yield *at, at != last, batch.slice(int(lo), int(hi - lo))
            last = at


def _row(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for file, block, begins, part in _stretches(batches):
        if begins:
            if held:
                yield _row(_RANGE, [held])
            held = file, block, False, True, False
        texts = part.column("value")
        has = pc.match_substring(texts, '"')
        if not pc.any(has).as_py():
            # Nothing changes; but outside, every line is a record of its own.
            continue
        lines = texts.filter(has).to_pylist()
        _, _, out_end, in_end, closes = held
        for ends in zip(*_steps(lines, [True] * len(lines)), strict=True):
            out_end, in_end = ends[out_end], ends[in_end]
            closes = closes or not in_end
        held = file, block, out_end, in_end, closes
    if held:
        yield _row(_RANGE, [held])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through the ranges of each file in order."""
    current, inside, owner = None, False, 0
    for batch in batches:
        rows = []
        for file, block, out_end, in_end, closes in zip(*[batch.column(f.name).to_pylist() for f in _RANGE], strict=True):
            if file != current:
                current, inside, owner = file, False, 0
            end = in_end if inside else out_end
            rows.append((file, block, inside, owner, end))
            if end and (not inside or closes):
                owner = block
            inside = end
        if rows:
            yield _row(_ENTRY, rows)


def _cut(header: bool, pieces: bool):
    """Whole records of the ranges, or the pieces of those that cross ranges."""

    def finish(held, rows):
        file, block, lines, owner, _ = held
        text = "\n".join(lines)
        if (owner is not None) == pieces:
            rows.append((file, block, owner, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: the record that goes on: file, range, its lines, the range where it began if it is a piece, inside
        held, first = None, False
        for file, block, begins, part in _stretches(batches):
            rows: list[tuple] = []
            if begins:
                if held:
                    finish((*held[:3], held[1] if held[3] is None else held[3], None), rows)
                inside, owner = part.column("inside")[0].as_py(), part.column("owner")[0].as_py()
                held, first = (file, block, [], owner, True) if inside else None, header and block == 0
            lines = part.column("value").to_pylist()
            has = pc.match_substring(part.column("value"), '"').to_pylist()
            for line, quoted in zip(lines, has, strict=True):
                if held is None:
                    inside = ends_inside(line, False) if quoted else False
                    if first:
                        # the header may have line ends in quotes too
                        first = inside
                        if inside:
                            held = (file, block, [], -1, True)
                        continue
                    if inside:
                        held = (file, block, [line], None, True)
                    elif not pieces:
                        rows.append((file, block, None, line))
                    continue
                held[2].append(line)
                if quoted and not ends_inside(line, True):
                    if held[3] != -1:
                        finish(held, rows)
                    held, first = None, False
            if rows:
                yield _row(_PIECE, rows)
        rows = []
        if held and held[3] != -1:
            finish((*held[:3], held[1] if held[3] is None else held[3], None), rows)
        if rows:
            yield _row(_PIECE, rows)

    return run


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One row per record: ``text``, without its line end. Blank lines are no records; the header of each file is left out.

    Fields are separated by commas; a quote opens at the beginning of a field and is doubled inside one. A line end is
    a line feed, with or without a carriage return before it.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    ranges = lines.mapInArrow(_summarise, _RANGE)
    entries = ranges.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_compose, _ENTRY)
    # One row per byte range of the scan, whatever its lines.
    whole = lines.join(F.broadcast(entries), ["file", "block"]).mapInArrow(_cut(header, False), _PIECE)
    crossed = F.broadcast(entries.filter("inside or open_end"))
    pieces = lines.join(crossed, ["file", "block"]).mapInArrow(_cut(header, True), _PIECE)
    in_order = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = pieces.groupBy("file", "owner").agg(F.array_join(F.transform(in_order, lambda p: p["text"]), "\n").alias("text"))
    found = whole.select("text").unionByName(joined.select("text"))
    return found.select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text <> ''")


def rows(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """The records as columns, by place. An empty field is null, a quoted empty one is the empty string."""
    # An empty field takes the null value; one that no file holds keeps it apart from a quoted empty one.
    options = {"quote": "\"", "escape": "\"", "emptyValue": "", "nullValue": "\u0001null\u0001", "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records(spark, path, header).select(F.from_csv("text", ddl, options).alias("r")).select("r.*")
