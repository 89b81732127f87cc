"""Token buckets replayed over a whole request log.

The rule is sequential per key: a bucket starts full at its first request; a request refills it only when a whole
interval has passed since the last refill, then by the exact elapsed fraction; a request takes one token or is denied.
Three readings of one range shuffle (``ordered.scan``) make it a distributed job:

* *When* a bucket refills depends on the timestamps alone, not on the tokens. Every possible entry into a slice ("no
  refill before T") leads to one exit, so a slice is a step function from entry to exit. Many entries meet in the same
  chain of refills, and steps that lead to one exit are kept as one.
* Knowing when it refills, a slice is a short list: a time and a number of requests per refill. At a *regeneration point*
  the bucket is full whatever came before: even an empty bucket, or one in debt, would have been refilled by then. From
  the last such point on the tokens are known without the slices before, so only slices without one hand their list on
  to be worked through in order.
* The last reading decides every request of a slice, starting from the known tokens.

A key without a limit (null capacity or rate) is not limited.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlake.operators import ordered as O

START, END = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_CAPACITY, _RATE, _KIND, _TOKENS, _LAST = "_capacity", "_rate", "_kind", "_tokens", "_last"


def last_refill_from(times: np.ndarray, interval: int) -> np.ndarray:
    """For each distinct time: the last refill inside ``times`` if a refill happens there."""
    n = len(times)
    hop = np.searchsorted(times, times + interval)
    hop = np.where(hop < n, hop, np.arange(n))
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            return times[hop]
        hop = further


def _steps(at: np.ndarray, leaves: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps that an entry up to ``bound`` can meet; neighbours that lead to one exit are one step."""
    n = min(int(np.searchsorted(at, bound, "right")) + 1, len(at))
    at, leaves = at[:n], leaves[:n]
    last = np.append(leaves[1:] != leaves[:-1], True)
    return at[last], leaves[last]


class Refills(O.Scan):
    """When a bucket may refill next, as a function of when it might have at the beginning.

    A state is (bound of the entries, times, next refill if the first refill is at that time).
    """

    state_bytes = 4096

    def __init__(self, ts: str, interval_us: int):
        self.columns, self.interval = (ts, _LAST), interval_us

    def run(self, state, columns, starts, n):
        if len(starts):
            state, begin = None, int(starts[-1])
            columns, n = {c: a.slice(begin) for c, a in columns.items()}, n - begin
        times, last = np.asarray(columns[self.columns[0]], np.int64), columns[_LAST]
        if state is None and last[0].is_valid:
            # the kept state of a bucket: wherever one comes from, it refilled then
            state, times = (END, np.array([END]), np.array([last[0].as_py() + self.interval])), times[1:]
        if len(times):
            times = np.unique(times)
            own = times, last_refill_from(times, self.interval) + self.interval
            bound = int(times[0]) + self.interval
            state = (bound, *_steps(*own, bound)) if state is None else self.join(state, (bound, *own))
        return {}, state

    def join(self, first, second):
        bound, at, leaves = first
        _, later, exits = second
        spot = np.searchsorted(later, leaves)
        through = np.where(spot < len(later), exits[np.minimum(spot, len(later) - 1)], leaves)
        fresh = later > at[-1]
        return bound, *_steps(np.append(at, later[fresh]), np.append(through, exits[fresh]), bound)


class Bucket(O.Scan):
    """Decides requests. A state is known, (None, tokens, last refill), or open: a list of refills to work through.

    An open state is (next refill, lowest tokens it may have, last refill, requests before the first refill, times of
    refills, requests after each, capacity, rate).
    """

    fields = (T.StructField("allowed", T.IntegerType()), T.StructField("delay_s", T.DoubleType()), T.StructField("tokens_left", T.DoubleType()), T.StructField("last_refill", T.LongType()))

    def __init__(self, ts: str, interval_s: float, wait: float):
        self.columns = (ts, _CAPACITY, _RATE, _TOKENS, _LAST)
        self.interval_s, self.interval, self.wait = interval_s, int(round(interval_s * 1_000_000)), wait
        self.before = Refills(ts, self.interval)

    def opened(self, entry):
        _, _, leaves = entry
        return int(leaves[0]), None, int(leaves[0]) - self.interval, 0, [], [], None, None

    def refilled(self, tokens: float, gap: int, capacity: float, rate: float) -> float:
        return min(capacity, tokens + gap / 1e6 / self.interval_s * rate)

    def lowest(self, rate: float) -> float:
        """Tokens never fall below this."""
        if self.wait < 0:
            return -math.inf
        return -(self.wait * rate / self.interval_s) - 1.0 if self.wait else 0.0

    def advance(self, state, times: np.ndarray, capacity: float, rate: float):
        """Take some requests into an open state; it becomes a known one at a regeneration point."""
        due, low, last, early, at, counts, *_ = state
        floor = self.lowest(rate)
        low = floor if low is None else low
        start = 0
        while start < len(times):
            stop = int(np.searchsorted(times, due))
            if stop > start:
                if at:
                    counts[-1] += stop - start
                else:
                    early += stop - start
                start = stop
                continue
            now = int(times[start])
            low = self.refilled(max(floor, low - (counts[-1] if at else early)), now - last, capacity, rate)
            if low >= capacity:
                return self.serve((None, capacity, now), times[start:], capacity, rate)[0]
            at.append(now)
            counts.append(0)
            last, due = now, now + self.interval
        return due, low, last, early, at, counts, capacity, rate

    def serve(self, state, times: np.ndarray, capacity: float | None, rate: float | None):
        """Decide some requests of one key; all up to the next refill at once."""
        n = len(times)
        allowed, delay, left, refill = np.ones(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if capacity is None or rate is None:
            return state, allowed, delay, left, refill
        allowed[:] = 0
        _, tokens, last = state or (None, float(capacity), int(times[0]))
        start = 0
        while start < n:
            now = int(times[start])
            if now - last >= self.interval:
                tokens, last = self.refilled(tokens, now - last, capacity, rate), now
            stop = max(int(np.searchsorted(times, last + self.interval)), start + 1)
            taken = granted(tokens, stop - start, rate, self.interval_s, self.wait)
            allowed[start:start + taken] = 1
            if taken and tokens - (taken - 1) < 1.0:
                missing = 1.0 - (tokens - np.arange(taken))
                delay[start:start + taken] = np.where(missing > 0, missing / rate * self.interval_s, 0.0)
            left[start:stop] = tokens - np.minimum(np.arange(1, stop - start + 1), taken)
            refill[start:stop] = last
            tokens -= taken
            start = stop
        return (None, tokens, last), allowed, delay, left, refill

    def run(self, state, columns, starts, n):
        ts, capacity, rate, tokens, last = (columns[c] for c in self.columns)
        times = np.asarray(ts, np.int64)
        if state is not None and state[0] is not None:
            return {}, self.advance(state, times, capacity[0].as_py(), rate[0].as_py()) if capacity[0].is_valid and rate[0].is_valid else (None, 0.0, 0)
        made = [np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)]
        kept = np.flatnonzero(np.asarray(pc.is_valid(last)))
        for lo, hi in zip([0, *starts], [*starts, n], strict=True):
            if lo == hi:
                continue
            if lo or not going_on(starts):
                state = None
                if len(kept) and kept[np.searchsorted(kept, lo) % len(kept)] == lo:
                    state, lo = (None, tokens[lo].as_py(), last[lo].as_py()), lo + 1
            if lo < hi:
                state, *new = self.serve(state, times[lo:hi], capacity[lo].as_py(), rate[lo].as_py())
                for whole, part in zip(made, new, strict=True):
                    whole[lo:hi] = part
        state = state or (None, 0.0, 0)
        return dict(zip([f.name for f in self.fields], map(pa.array, made), strict=True)), state

    def join(self, first, second):
        if second[0] is None:
            return second
        _, tokens, last = first
        *_, early, at, counts, capacity, rate = second
        tokens -= granted(tokens, early, rate, self.interval_s, self.wait)
        for now, n in zip(at, counts, strict=True):
            tokens, last = self.refilled(tokens, now - last, capacity, rate), now
            tokens -= granted(tokens, n, rate, self.interval_s, self.wait)
        return None, tokens, last


def going_on(starts: np.ndarray) -> bool:
    """Whether the first row goes on with the key before."""
    return not len(starts) or bool(starts[0])


def replay(
    requests: DataFrame, keys: Sequence[str], ts: str, order_id: str,
    capacity: Column, rate: Column, interval_s: float = 1.0, max_wait_s: float | None = 0.0, kept: DataFrame | None = None,
) -> DataFrame:
    """Decide every request: ``allowed`` (0/1) and ``delay_s``; with ``kept``, also what is left of the buckets.

    ``max_wait_s`` 0 is the plain bucket; above 0 a request may reserve a token that is still to come and waits for it;
    ``None`` waits without limit. ``capacity`` and ``rate`` (tokens per interval) may depend on the key columns.
    ``kept`` holds buckets that requests before these ones have left: ``tokens_left`` and ``last_refill``, one row per key.
    Rows without a time are judged as the first ones of their key.
    """
    wait = -1.0 if max_wait_s is None else float(max_wait_s)
    at = F.coalesce(F.col(ts), F.lit(0)).cast("bigint")
    log = requests.withColumns({"_ts": at, _KIND: F.lit(1)})
    if kept is not None:
        before = kept.select(*keys, F.col("tokens_left").alias(_TOKENS), F.col("last_refill").alias(_LAST), F.col("last_refill").alias("_ts"), F.lit(0).alias(_KIND))
        log = log.unionByName(before, allowMissingColumns=True)
    else:
        log = log.withColumns({_TOKENS: F.lit(None).cast("double"), _LAST: F.lit(None).cast("bigint")})
    log = log.withColumns({_CAPACITY: capacity.cast("double"), _RATE: rate.cast("double")})
    done = O.scan(log, keys, [_KIND, "_ts", order_id], Bucket("_ts", interval_s, wait)).filter(F.col(_KIND) == 1)
    gone = ["_ts", _KIND, _TOKENS, _LAST, _CAPACITY, _RATE]
    return done.drop(*gone) if kept is not None else done.drop(*gone, "tokens_left", "last_refill")


def granted(tokens: float, n: int, rate: float, interval_s: float, max_wait_s: float) -> int:
    """How many of ``n`` requests between two refills are admitted."""
    if max_wait_s < 0:
        return n
    if max_wait_s == 0 or rate <= 0:
        return min(n, int(tokens)) if tokens >= 1 else 0

    def admits(taken: int) -> bool:
        missing = 1.0 - (tokens - taken)
        return missing <= 0 or missing / rate * interval_s <= max_wait_s

    guess = min(max(int(math.floor(tokens + max_wait_s * rate / interval_s)), 0), n)
    while guess > 0 and not admits(guess - 1):
        guess -= 1
    while guess < n and admits(guess):
        guess += 1
    return guess


def two_buckets(
    requests: DataFrame, endpoint_keys: Sequence[str], app_keys: Sequence[str], ts: str, order_id: str,
    endpoint_limit: tuple[Column, Column], app_limit: tuple[Column, Column], interval_s: float = 1.0,
) -> DataFrame:
    """Endpoint and application bucket together; both are charged even if one denies."""
    own = replay(requests, endpoint_keys, ts, order_id, *endpoint_limit, interval_s)
    own = own.withColumnRenamed("allowed", "endpoint_allowed").drop("delay_s")
    both = replay(own, app_keys, ts, order_id, *app_limit, interval_s)
    both = both.withColumnRenamed("allowed", "app_allowed").drop("delay_s")
    return both.withColumn("allowed", F.col("endpoint_allowed") * F.col("app_allowed"))
