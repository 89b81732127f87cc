"""Periodic runs of words: stretches that repeat themselves at least twice.

A *run* is a stretch of words with smallest period q (words q apart are identical), at least ``least`` words and two
periods long, that no neighbouring word extends. On the diagonal of lag q, which compares word i with word i + q, a run
is one maximal match of at least max(least - q, q) words. So every run can be found from a seed:

* The k-grams of half ``least`` are the shortest overlap that a run guarantees. For lags below ``least`` every place is a
  seed; for lags from 2k to 4k the overlap is 2k at least, so it holds a whole k-gram at some multiple of k, and k
  doubles from class to class. Two k-grams are equal when their ranks are; ranks of 2k-grams come from pairs of ranks.
* The occurrences of a k-gram in one document are enumerated with the lags of the class only: at most 2n pairs for a
  document of n words, whatever repeats in it, and n log n over all classes.
* Pairs in order of (lag, place) form the table of the furthest place that each lag has covered: a pair that begins
  where the one before it ends belongs to the same match and is not extended again. The ends of a match are extended by
  whole grams, largest first.

A match on a lag that is no smallest period is the same stretch as a run of a smaller one, and gives way to it.

Defined results: null, empty and blank texts have no words; texts are never cut, a long one makes a slice of its own;
a null id counts as the empty id; equal rows give equal results; an empty table gives an empty table; columns of the
input that have the name of a new one are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from postlake.llm.arrow import batch_of, map_slices

#: Pairs of occurrences that are held at once (pairs of one lag are never split).
PAIRS = 1 << 21


class Runs(NamedTuple):
    """Runs of all texts of a slice, by text, start and period; places count from the first word of the slice."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal tuples."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


class Grams:
    """Ranks of the k-grams of a slice for one k; -1 where no equal gram stands in the same text."""

    def __init__(self, size: int, rank: np.ndarray):
        self.size, self.rank = size, rank


def _repeated(size: int, at: np.ndarray, doc: np.ndarray, *keys: np.ndarray, n: int) -> Grams:
    """Keep what occurs twice in a text; ``keys`` tell grams apart."""
    out = np.full(n, -1, np.int64)
    if len(at):
        rank = _rank(*keys, doc[at])
        twice = np.bincount(rank)[rank] > 1
        out[at[twice]] = rank[twice]
    return Grams(size, out)


def first_grams(words: np.ndarray, doc: np.ndarray, end: np.ndarray, size: int) -> Grams:
    """Grams of ``size`` words, put together from shorter ones."""
    n, have, rank = len(words), 1, words
    at = np.arange(n)
    while have < size:
        step = min(have, size - have)
        # two grams of ``have`` words that overlap or touch make one of ``have + step``
        at = at[at + have + step <= end[at]]
        longer = np.full(n, -1, np.int64)
        if len(at):
            longer[at] = _rank(rank[at + step], rank[at])
        rank, have = longer, have + step
    return _repeated(size, at, doc, rank[at], n=n)


def doubled(grams: Grams, doc: np.ndarray, end: np.ndarray) -> Grams:
    """Grams of twice the size; only repeated grams can start or end a repeated longer one."""
    k, rank = grams.size, grams.rank
    at = np.flatnonzero(rank >= 0)
    at = at[at + 2 * k <= end[at]]
    at = at[rank[at + k] >= 0]
    return _repeated(2 * k, at, doc, rank[at + k], rank[at], n=len(rank))


def seeds(grams: Grams, anchors: np.ndarray, doc: np.ndarray, low: int, high: int):
    """Matches (lag, first place, end of the last gram) of anchors with the same gram ``low`` to ``high`` - 1 further on.

    Touching pairs of a lag are one match: the table of covered places is the sorted array itself.
    """
    rank, n, k = grams.rank, len(grams.rank), grams.size
    anchors = anchors[rank[anchors] >= 0]
    places = np.flatnonzero(rank >= 0)
    order = places[np.argsort(rank[places], kind="stable")]
    index = rank[order] * n + order     # occurrences by gram, then place; ranks are dense, so this stays below n * n
    span = max(1, PAIRS // max(len(anchors), 1))
    for lag in range(low, high, span):
        base = rank[anchors] * n
        left = np.searchsorted(index, base + np.minimum(anchors + lag, n - 1) + (anchors + lag >= n))
        right = np.searchsorted(index, base + np.minimum(anchors + min(lag + span, high), n))
        count = np.maximum(right - left, 0)
        total = int(count.sum())
        if not total:
            continue
        first = np.repeat(anchors, count)
        other = order[np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
        lags = other - first
        # ranks hold the text, so both places are of one text
        by = np.lexsort((first, lags))
        first, lags = first[by], lags[by]
        fresh = np.ones(total, bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (first[1:] > first[:-1] + k) | (doc[first[1:]] != doc[first[:-1]])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], total) - 1
        yield lags[begin], first[begin], first[last] + k


def extend(levels: list[Grams], words: np.ndarray, begin: np.ndarray, end: np.ndarray, lag, a, z):
    """The whole match around [a, z) on each lag, inside the text [begin, end)."""
    a, z, most = a.copy(), z.copy(), len(words) - 1
    for grams in [*reversed(levels), Grams(1, words)]:
        k, rank = grams.size, grams.rank
        for _ in range(1 if k > levels[0].size else levels[0].size):
            fits = z + lag + k <= end
            one, two = rank[np.minimum(z, most)], rank[np.minimum(z + lag, most)]
            right = fits & (one == two) & (one >= 0)
            z = z + k * right
            back = np.maximum(a - k, 0)
            one, two = rank[back], rank[np.minimum(back + lag, most)]
            left = (a - k >= begin) & (one == two) & (one >= 0)
            a = a - k * left
            if not (left.any() or right.any()):
                break
    return a, z


def find(words: np.ndarray, first: np.ndarray, least: int = 12) -> Runs:
    """Runs of all texts: ``words`` are numbers (equal words, equal numbers), ``first`` is where each text begins (n + 1)."""
    n, sizes = len(words), np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = first[:-1][doc], first[1:][doc]
    place = np.arange(n) - begin
    k = least // 2
    grams = first_grams(words, doc, end, k)
    levels, found = [grams], []
    low, high, step = 1, 2 * k, 1
    while low < n and (grams.rank >= 0).any():
        anchors = np.flatnonzero(place % step == 0)
        for lag, a, z in seeds(grams, anchors, doc, low, high):
            at = a
            a, z = extend(levels, words, begin[at], end[at], lag, a, z)
            good = z - a >= np.maximum(least - lag, lag)
            found.append((doc[at[good]], a[good], (z + lag)[good], lag[good]))
        low, high, step = high, 2 * high, high // 2
        if step > k:
            grams = doubled(grams, doc, end)
            levels.append(grams)
    if not found:
        return Runs(*[np.zeros(0, np.int64)] * 4)
    d, s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s, d))
    d, s, e, q = d[order], s[order], e[order], q[order]
    smallest = np.ones(len(d), bool)
    smallest[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    d, s, e, q = d[smallest], s[smallest], e[smallest], q[smallest]
    order = np.lexsort((q, s, d))
    return Runs(d[order], s[order], e[order], q[order])


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a text; for one id in ten they repeat themselves from some word on, with a period set by the id."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return words[:a] + (root * ((n - a) // p + 1))[:n - a]


def analyse(texts: list[str | None], ids: list, plant: bool, least: int):
    """Per text its words, its runs (start, length, period) by start and period, and the words that no run repeats."""
    number: dict[bytes, int] = {}
    told = [(t or "").encode().split() for t in texts]  # bytes are split at blank, tab, line feed, VT, FF and CR
    if plant:
        told = [planted(w, d) for w, d in zip(told, ids, strict=True)]
    flat = np.array([number.setdefault(w, len(number)) for ws in told for w in ws], np.int64)
    first = np.cumsum([0, *map(len, told)])
    runs = find(flat, first, least)
    # words that a run repeats: all but its first period
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    bound = np.searchsorted(runs.doc, np.arange(len(told) + 1))
    starts, lengths, periods = (runs.start - first[runs.doc]).tolist(), (runs.end - runs.start).tolist(), runs.period.tolist()
    for i, ws in enumerate(told):
        lo, hi = bound[i], bound[i + 1]
        mine = list(zip(starts[lo:hi], lengths[lo:hi], periods[lo:hi], strict=True))
        kept = ws
        if mine:
            out = gone[first[i]:first[i + 1]].tolist()
            kept = [w for w, g in zip(ws, out, strict=True) if not g]
        yield mine, kept


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _run(docs: DataFrame, text: str, doc_id: str, keep: tuple[str, ...], plant: bool, least: int, new: list, finish) -> DataFrame:
    if least < 2 or least % 2:
        raise ValueError("least must be even")
    schema = T.StructType([*[docs.schema[c] for c in keep if c not in {f.name for f in new}], *new])

    def make():
        def step(part: pa.RecordBatch):
            got = list(analyse(part.column(text).to_pylist(), part.column(doc_id).to_pylist(), plant, least))
            yield batch_of(schema, {c: part.column(c) for c in keep} | finish(got))

        return step

    return map_slices(docs.select(*dict.fromkeys([*keep, doc_id, text])), text, schema, make)


def collapse(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), least: int = 12, plant: bool = False,
) -> DataFrame:
    """The columns of ``keep``, all ``runs`` (start, length, period) and the text ``collapsed`` to what no run repeats."""
    new = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]

    def finish(got):
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine, _ in got]
        return {"runs": rows, "collapsed": [b" ".join(kept).decode() for _, kept in got]}

    return _run(docs, text, doc_id, keep, plant, least, new, finish)


def digests(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), least: int = 12, plant: bool = True,
) -> DataFrame:
    """Number of runs, the longest one, and SHA-256 of the list of runs and of the collapsed text."""
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    new = [*[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]]

    def row(mine, kept):
        best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * best[1] // best[2] if mine else None
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in mine])
        return len(mine), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()

    def finish(got):
        rows = [row(mine, kept) for mine, kept in got]
        return {f.name: [r[i] for r in rows] for i, f in enumerate(new)}

    return _run(docs, text, doc_id, keep, plant, least, new, finish)
