"""Ordered state per key as a segmented scan over one range shuffle.

Rows are range-partitioned by (key, order); each range is a *slice* and a busy key simply owns many of them. A slice is
read in order twice, from the same shuffle files. The first reading turns the rows of its first and of its last key into
a *state*, an element of an associative operation (the key may go on in another slice only at these two places). The
states, two per slice at most, are folded in order of the slices, and the second reading starts each slice with what all
earlier slices of its first key come to. No key stands in one task, no rows are stored, and nothing runs before the
result is asked for.

Both readings have to see the same slices. The range exchange is dealt by all columns, so that both plans need the same
ones below it and the engine reuses the exchange; and every slice compares its first row with the one that the first
reading saw, so a plan that would not reuse it ends in an error and never in a wrong result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from postlake.session import input_bytes

#: Bytes of input for one slice, and the bytes of states that all slices together may broadcast.
SLICE_BYTES, CARRY_BYTES = 64 << 20, 256 << 20
#: A small table is cut into so many slices, or into slices of so many bytes, if the session asks for more.
FEW_SLICES, PIECE_BYTES = 16, 1 << 20


class Scan:
    """What a segmented scan computes.

    ``run`` takes the state of the rows before (None: there are none) and the columns of some rows of one or more keys;
    ``starts`` are the places where a key begins (a first row that goes on with the key of ``state`` is not one of them).
    It returns the new columns and the state of the last key. ``join`` puts the states of two stretches of a key together.
    """

    columns: tuple[str, ...] = ()
    fields: tuple[T.StructField, ...] = ()
    #: A scan that comes first; ``opened`` makes its state at the beginning of a slice one of this scan.
    before: Scan | None = None
    #: An upper bound of a pickled state.
    state_bytes = 400

    def run(self, state, columns: dict[str, pa.Array], starts: np.ndarray, n: int):
        raise NotImplementedError

    def join(self, first, second):
        raise NotImplementedError

    def opened(self, entry):
        raise NotImplementedError


def begins(starts: np.ndarray, n: int) -> np.ndarray:
    """For each row the place where its key begins; 0 for rows that go on with an earlier key."""
    edge = np.zeros(n, np.int64)
    edge[starts] = starts
    return np.maximum.accumulate(edge)


def going_on(starts: np.ndarray, n: int) -> int:
    """How many leading rows go on with the key before."""
    return int(starts[0]) if len(starts) else n


class Position(Scan):
    """1-based position of a row within its key."""

    def __init__(self, name: str = "rn"):
        self.fields = (T.StructField(name, T.LongType()),)

    def run(self, state, columns, starts, n):
        place = np.arange(1, n + 1) - begins(starts, n)
        place[:going_on(starts, n)] += state or 0
        return {self.fields[0].name: pa.array(place)}, int(place[-1])

    def join(self, first, second):
        return first + second


class Rolling(Scan):
    """Mean over the last ``depth`` rows of a key, each row a constant amount of work.

    The rows of a key are cut into blocks of ``depth``. A window is the end of one block and the beginning of the next:
    a sum from the right and a sum from the left, both inside their block. Nothing is ever subtracted, so a value that
    is no number, or a huge one, spoils only the windows that hold it.
    """

    fields = (T.StructField("rolling_mean", T.DoubleType()), T.StructField("n_in_window", T.LongType()))

    def __init__(self, value: str, depth: int):
        if depth < 1:
            raise ValueError("depth must be 1 or more")
        self.columns, self.depth, self.state_bytes = (value,), depth, 16 * depth + 400

    def run(self, state, columns, starts, n):
        depth, column = self.depth, columns[self.columns[0]].cast(pa.float64())
        valid = np.asarray(pc.is_valid(column)).astype(np.int64)
        value = np.asarray(pc.fill_null(column, 0.0), np.float64)
        before, old, had = state or (0, np.zeros(0), np.zeros(0, np.int64))
        if going_on(starts, n) == 0:
            before, old, had = 0, old[:0], had[:0]
        back = len(old)
        value, valid, starts = np.concatenate([old, value]), np.concatenate([had, valid]), starts + back
        total = len(value)
        begin = begins(starts, total)
        place = np.arange(total) - begin      # 0-based position in the key
        place[:going_on(starts, total)] += before - back
        block = np.concatenate([[0], np.cumsum((place[1:] % depth == 0) | (begin[1:] != begin[:-1]))])
        left = _sums(value, block), _sums(valid, block)
        right = _sums(value[::-1], -block[::-1])[::-1], _sums(valid[::-1], -block[::-1])[::-1]
        # The window reaches back into the block before, unless it is a whole block or the key's first rows.
        reach = np.flatnonzero((place >= depth) & (place % depth != depth - 1))
        reach = reach[reach >= back]
        for one, other in zip(left, right, strict=True):
            one[reach] = other[reach - depth + 1] + one[reach]
        total_value, count = left[0][back:], left[1][back:]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total_value / count
        keep = max(int(begin[-1]), total - depth + 1)
        state = (int(place[-1]) + 1, value[keep:].copy(), valid[keep:].copy())
        return {"rolling_mean": pa.array(mean, mask=count == 0), "n_in_window": pa.array(count)}, state

    def join(self, first, second):
        n = first[0] + second[0]
        both = [np.concatenate([a, b])[-(self.depth - 1):] if self.depth > 1 else b for a, b in zip(first[1:], second[1:], strict=True)]
        return n, *both


def _sums(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums inside each group of neighbours; what is no finite number is counted and put in afterwards."""
    running = lambda x: pd.Series(x).groupby(group, sort=False).cumsum().to_numpy(copy=True)
    if values.dtype.kind != "f" or np.isfinite(values).all():
        return running(values)
    out = running(np.where(np.isfinite(values), values, 0.0))
    for odd, made in ((values == np.inf, np.inf), (values == -np.inf, -np.inf), (np.isnan(values), np.nan)):
        met = running(odd.astype(np.int64)) > 0
        with np.errstate(invalid="ignore"):
            out[met] += made
    return out


class Streak(Scan):
    """Consecutive failures at each row, and whether the key has ever reached the limit."""

    fields = (T.StructField("streak", T.LongType()), T.StructField("disabled", T.IntegerType()))

    def __init__(self, failed: str, disable_at: int):
        self.columns, self.disable_at = (failed,), disable_at

    def run(self, state, columns, starts, n):
        failed = np.asarray(pc.fill_null(columns[self.columns[0]], False)).astype(bool)
        here, begin, leading = np.arange(n), begins(starts, n), going_on(starts, n)
        count, lead, trail, off = state or (0, 0, 0, False)
        last_ok = np.maximum.accumulate(np.where(failed, begin - 1, here))
        streak = here - last_ok
        streak[:leading] += np.where(last_ok[:leading] < 0, trail, 0)
        reached = np.maximum.accumulate(np.where(streak >= self.disable_at, here, -1)) >= begin
        reached[:leading] |= off
        at = int(begin[-1])
        ok = np.flatnonzero(~failed[at:])
        head = int(ok[0]) if len(ok) else n - at
        if leading == n and state:
            lead = count + head if lead == count else lead
        else:
            count, lead = 0, head
        after = (count + n - at, lead, int(streak[-1]), bool(reached[-1]))
        return {"streak": pa.array(streak), "disabled": pa.array(reached.astype(np.int32))}, after

    def join(self, first, second):
        (n, lead, trail, off), (m, ahead, tail, gone) = first, second
        meets = ahead > 0 and trail + ahead >= self.disable_at
        return n + m, n + ahead if lead == n else lead, trail + m if ahead == m else tail, off or gone or meets


class Gauge(Scan):
    """Running sum of steps that never falls below zero: the sum less its lowest point so far."""

    fields = (T.StructField("gauge", T.LongType()),)

    def __init__(self, step: str):
        self.columns = (step,)

    def run(self, state, columns, starts, n):
        step = np.asarray(pc.fill_null(columns[self.columns[0]], 0)).astype(np.int64)
        begin, leading = begins(starts, n), going_on(starts, n)
        total = np.cumsum(step)
        level = total - (total - step)[begin]
        before, low = state or (0, 0)
        level[:leading] += before
        # A key's rows lie wholly below those of the key before it, so the running minimum begins anew with each key.
        number = np.cumsum(np.isin(np.arange(n), starts))
        fall = number * (int(level.max()) - min(int(level.min()), low, 0) + 1)
        lowest = np.minimum.accumulate(level - fall) + fall
        lowest[:leading] = np.minimum(lowest[:leading], low)
        lowest = np.minimum(lowest, 0)
        return {"gauge": pa.array(level - lowest)}, (int(level[-1]), int(lowest[-1]))

    def join(self, first, second):
        return first[0] + second[0], min(first[1], first[0] + second[1])


# ---- the machinery ------------------------------------------------------------------------------------------------

_AT, _MARK, _STATE = "_scan_at", "_scan_mark", "_scan_state"
_SHIFT = 33  # bits of the row number below the slice in ``monotonically_increasing_id``


def slices_for(df: DataFrame, state_bytes: int) -> int:
    """One slice for so many bytes of input, the session's shuffle partitions at least, as many as may be broadcast at most.

    Every slice is a Python task in each reading, whose fixed cost outweighs the work on few rows. So a table has no more of
    them than pieces, whatever the session's partitions are; one that does not know its size has as many as those.
    """
    wanted, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    if size is not None:
        wanted = max(min(wanted, max(FEW_SLICES, size // PIECE_BYTES + 1)), size // SLICE_BYTES + 1)
    return max(1, min(wanted, CARRY_BYTES // state_bytes))


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: int) -> DataFrame:
    rest = [c for c in df.columns if c not in {*keys, *[o for o in order if isinstance(o, str)]}]
    by = [*keys, *order, *([F.xxhash64(*rest)] if rest else [])]
    placed = df.repartitionByRange(slices, *by).sortWithinPartitions(*by)
    return placed.withColumns({_AT: F.monotonically_increasing_id(), _MARK: F.xxhash64(*df.columns)})


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> np.ndarray:
    """Where a key begins in a sorted batch, after a row of key ``last``; nulls and NaN are keys like any other."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(1), column.slice(0, n - 1)
        differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
        if pa.types.is_floating(column.type):
            differ &= ~np.asarray(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new[1:] |= differ
    new[0] = last is None or not _same(last, _key(batch, keys, 0))
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _cut(batch: pa.RecordBatch, columns: Sequence[str], lo: int, hi: int) -> dict[str, pa.Array]:
    return {c: batch.column(c).slice(lo, hi - lo) for c in columns}


def _row(target: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array([columns[f.name]], f.type) for f in target], schema=target)


def _met(placed: DataFrame, carry: DataFrame) -> DataFrame:
    """Each slice's first row beside what it carries over; two entries per slice at most, so they are broadcast."""
    return placed.join(F.broadcast(carry), F.col(_AT) == F.col("_at"), "left")


def _entry(batch: pa.RecordBatch):
    """What the first row of a slice carries over."""
    if batch.column("_mark")[0].as_py() != batch.column(_MARK)[0].as_py():
        raise RuntimeError("two readings of the log saw different slices")
    packed = batch.column(_STATE)[0].as_py()
    return None if packed is None else pickle.loads(packed)


def _carry(placed: DataFrame, keys: Sequence[str], what: Scan) -> DataFrame:
    """Per slice its first row and the state of the rows of its first key in all earlier slices."""
    named = [T.StructField(f"_k{i}", placed.schema[k].dataType) for i, k in enumerate(keys)]
    names = [f.name for f in named]
    summary = T.StructType([
        *named, T.StructField(_AT, T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField(_MARK, T.LongType()), T.StructField(_STATE, T.BinaryType()),
    ])
    carried = T.StructType([T.StructField("_at", T.LongType()), T.StructField("_mark", T.LongType()), T.StructField(_STATE, T.BinaryType())])
    used, nothing, new = [*dict.fromkeys([*keys, *what.columns]), _AT, _MARK], np.zeros(0, np.int64), np.zeros(1, np.int64)
    told = what.before is not None
    read = _met(placed, _carry(placed, keys, what.before)).select(*used, "_mark", _STATE) if told else placed.select(*used)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states of the first and the last key of a slice."""
        target = to_arrow_schema(summary)
        key, state, part, at, mark, entry = None, None, 0, 0, 0, None

        def made():
            own = {f"_k{i}": pa.array([v], target.field(f"_k{i}").type) for i, v in enumerate(key)}
            return _row(target, **own, **{_AT: at, "part": part, _MARK: mark, _STATE: pickle.dumps(state)})

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if key is None:
                at, mark = batch.column(_AT)[0].as_py(), batch.column(_MARK)[0].as_py()
                entry = _entry(batch) if told else None
            starts = _changes(batch, keys, key)
            more = going_on(starts, n)
            if more:
                state = what.run(state, _cut(batch, what.columns, 0, more), nothing, more)[1]
            if not len(starts):
                continue
            if key is None:
                # the first key of the slice, which may end in this batch
                key, end = _key(batch, keys, 0), int(starts[1]) if len(starts) > 1 else n
                opened, fresh = (None, new) if entry is None else (what.opened(entry), nothing)
                state = what.run(opened, _cut(batch, what.columns, 0, end), fresh, end)[1]
                starts = starts[1:]
                if not len(starts):
                    continue
            if part == 0:
                yield made()
                part = 1
            begin = int(starts[-1])
            key = _key(batch, keys, begin)
            state = what.run(None, _cut(batch, what.columns, begin, n), new, n - begin)[1]
        if key is not None:
            yield made()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, key, state = to_arrow_schema(carried), None, None
        for batch in batches:
            columns = [batch.column(f.name).to_pylist() for f in summary]
            for *own, at, part, mark, packed in zip(*columns, strict=True):
                if key is None or not _same(key, tuple(own)):
                    key, state = tuple(own), None
                if part == 0:
                    yield _row(target, **{"_at": at, "_mark": mark, _STATE: None if state is None else pickle.dumps(state)})
                found = pickle.loads(packed)
                state = found if state is None else what.join(state, found)

    states = read.mapInArrow(summarise, summary)
    together = states.repartition(*names) if names else states.repartition(1)
    return together.sortWithinPartitions(*names, _AT, "part").mapInArrow(fold, carried)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], what: Scan) -> DataFrame:
    """Add the columns of ``what`` to every row of ``df``; columns of these names are replaced.

    ``order`` should end in a unique column; a hash of the row settles ties. Keys and order must be sortable. Without
    keys all rows are one group, still cut into slices, and the result is in order.
    """
    keys, order = list(keys), list(order)
    df = df.drop(*[f.name for f in what.fields])
    placed = _ranged(df, keys, order, slices_for(df, what.state_bytes))
    out, own = T.StructType([*df.schema.fields, *what.fields]), df.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, key, state = to_arrow_schema(out), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = _changes(batch, keys, key)
            if key is None and (state := _entry(batch)) is not None:
                starts = starts[1:]
            new, state = what.run(state, _cut(batch, what.columns, 0, n), starts, n)
            key = _key(batch, keys, n - 1)
            kept = [batch.column(c) for c in own]
            made = [new[f.name].cast(target.field(f.name).type) for f in what.fields]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=target)

    return _met(placed, _carry(placed, keys, what)).mapInArrow(apply, out)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position of every row within its key."""
    return scan(df, keys, order, Position(name))
