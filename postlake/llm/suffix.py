"""Suffix-array deduplication over a prefix-free parse, in partitions.

A rolling hash of ``GRAM`` bytes triggers the parse: the trigger of a span of ``SPAN`` bytes is the gram of least hash
in it, leftmost if several, so equal spans have equal triggers at equal places. Starts in a row with one trigger, with
the bytes of their spans, are a phrase; phrases overlap so that each span lies inside one phrase, and phrases of one
trigger meet in one partition. There the distinct phrases are the dictionary and their occurrences, by document, the
parse. The dictionary's suffix array (ranks of 8, 16, 32 and 50 bytes by doubling) and the order of the parse give
corpus order: spans that are equal stand together, the one of the smallest doc_id first; all in larger documents go.

Only phrases whose trigger occurs in two documents can matter, so triggers travel first, each with 40 bits of a digest of
its phrase. A second pass sends the texts of phrases whose trigger has several phrases, and a 64-bit digest where all its
phrases are one (plain copies); other phrases stay at home. Between the passes documents travel in compressed slices.
Slices of one task make packs of ``PACK_BYTES``, and the buckets of large tables travel ``TOGETHER``, so that few rows go
between the steps: one per pack and group of buckets. A pack is named by its place in the scan and its content; a pack
that cannot be found again is an error.

Defined results: null and empty texts have no byte; a text shorter than a span loses nothing; a row with a null doc_id
neither loses nor removes anything; rows of equal doc_id do not remove each other; an empty table gives an empty table;
input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm import words as W
from postlake.llm.arrow import batch_of, flat, slices

SPAN, GRAM = 50, 24
#: Bytes of texts whose phrases make one partition.
BUCKET_BYTES = 6 << 20
#: Bytes of texts whose phrases are sent together.
PACK_BYTES = 16 << 20
#: Buckets that share a row, once there are ``GROUPS`` groups of so many; each is still worked through alone.
TOGETHER, GROUPS = 4, 128
#: Bytes of texts that are parsed at once: their hashes stay in the cache.
PARSE_BYTES = 128 << 10
#: Occurrences of phrases whose spans are looked at together.
BLOCK = 1 << 16
_U = np.uint64
_BYTE = W.stream(31, 256)
_STEP = [W.stream(32, 8)[i:i + 1] | _U(1) for i in range(8)]


def _packed(number: str, names: str) -> T.StructType:
    """A number and arrays packed as bytes."""
    return T.StructType([T.StructField(number, T.LongType()), *[T.StructField(n, T.BinaryType()) for n in names.split()]])


def grams(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the GRAM bytes from each place on."""
    h, n, k = _BYTE[data], 1, 0
    while n < GRAM:
        step = min(n, GRAM - n)
        h = h[:-step] * _STEP[k] + h[step:] if len(h) > step else h[:0]
        n, k = n + step, k + 1
    return W.mix(h)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of all texts in order: text, first span, number of spans, hash of the trigger, digest of the phrase."""
    none = np.zeros(0, np.int64)
    h = grams(data)
    width = SPAN - GRAM + 1
    if len(h) < width:
        return none, none, none, np.zeros(0, _U), np.zeros(0, _U)
    low = (h >> _U(32)) << _U(32) | np.arange(len(h), dtype=_U)
    n = 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    low = np.minimum(low[:-(width - n)], low[width - n:]) if n < width else low
    trigger = (low & _U(0xFFFFFFFF)).astype(np.uint32)
    # A run of one trigger ends where its text or the text's last span ends; runs behind that are left out.
    new = np.ones(len(trigger) + 1, bool)
    new[1:-1] = trigger[1:] != trigger[:-1]
    edges = np.concatenate([offsets, offsets[1:] - SPAN + 1])
    new[edges[(edges >= 0) & (edges < len(trigger))]] = True
    begin = np.flatnonzero(new)
    start, spans = begin[:-1], np.diff(begin)
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + SPAN <= offsets[text + 1]
    text, start, spans = text[inside], start[inside], spans[inside]
    # Four grams cover the bytes of a phrase: two from its front, two from its end.
    end = start + spans + SPAN - 1
    digest = W.mix(spans.astype(_U))
    for at in (start, start + GRAM, end - 2 * GRAM, end - GRAM):
        digest = W.mix(digest + h[at])
    return text, start, spans, h[trigger[start]], digest


def _together(buckets: int) -> int:
    """How many buckets share a row."""
    return max(1, min(TOGETHER, buckets // GROUPS))


def _packs(batches, step):
    """(name, what ``step`` makes of each slice) of all packs of a task."""
    place, made, size, name = 0, [], 0, None
    for batch in batches:
        for part in slices(batch, "_text"):
            data, offsets = flat(part.column("_text"))
            more = len(data) + SPAN * part.num_rows
            if made and size + more > PACK_BYTES:
                yield name.digest(), made
                made, size = [], 0
            if not made:
                name = hashlib.blake2b(f"{TaskContext.get().partitionId()}:{place}".encode(), digest_size=16)
                place += 1
            name.update(offsets.tobytes())
            name.update(data)
            made.append(step(part))
            size += more
    if made:
        yield name.digest(), made


def _parsed(part: pa.RecordBatch) -> tuple[int, tuple[np.ndarray, ...]]:
    """Rows of a slice, and the phrases of documents that have an id: text, place in it, spans, trigger, digest."""
    known, rows, found = np.array(part.column("_id").is_valid()), 0, []
    for piece in slices(part, "_text", PARSE_BYTES):
        data, offsets = flat(piece.column("_text"))
        text, start, spans, trigger, digest = parse(data, offsets)
        has = known[rows + text]
        text, start = text[has], start[has]
        found.append((
            (text + rows).astype(np.uint32), (start - offsets[text]).astype(np.uint32), spans[has].astype(np.uint8),
            W.mix(trigger[has]), digest[has]))
        rows += piece.num_rows
    return rows, tuple(map(np.concatenate, zip(*found, strict=True)))


class _Sorted(NamedTuple):
    """The phrases of a pack, and their entries: rows of equal ones in the order of the triggers."""

    text: np.ndarray    # of each phrase, in the order of the texts
    start: np.ndarray
    spans: np.ndarray
    order: np.ndarray   # phrases in the order of their triggers, those of one in the order of the texts
    entry: np.ndarray   # entry of each of these
    first: np.ndarray   # first phrase of each entry
    bucket: np.ndarray  # of each entry, ascending
    value: np.ndarray   # 24 bits of the trigger beside those that the bucket holds, and 40 of the phrase
    twice: np.ndarray   # whether two texts of the pack have the trigger
    digest: np.ndarray


def _sorted(parsed: list, buckets: int) -> _Sorted:
    rows = np.cumsum([0, *[n for n, _ in parsed]])
    text = np.concatenate([x[0] + np.uint32(at) for at, (_, x) in zip(rows[:-1], parsed, strict=True)])
    start, spans, trigger, digest = (np.concatenate([x[i] for _, x in parsed]) for i in range(1, 5))
    # Stable, as another pass has to find the same entries.
    order = np.argsort(trigger, kind="stable")
    trigger, digest = trigger[order], digest[order]
    other = np.ones(len(order), bool)
    other[1:] = trigger[1:] != trigger[:-1]
    new = other.copy()
    new[1:] |= digest[1:] != digest[:-1]
    begin, each = np.flatnonzero(new), np.flatnonzero(other)
    last = np.append(each[1:], len(order))[:len(each)] - 1
    twice = (text[order[each]] != text[order[last]])[np.cumsum(other)[begin] - 1]
    trigger, digest = trigger[begin], digest[begin]
    bucket = ((trigger >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    value = (trigger & _U(0xFFFFFF)) << _U(40) | digest >> _U(24)
    return _Sorted(text, start, spans, order, np.cumsum(new) - 1, order[begin], bucket, value, twice, digest)


def _packed_slices(docs: DataFrame) -> DataFrame:
    """Slices as compressed Arrow bytes, under the name of their pack. Both passes read the same columns, so that batches repeat."""
    out = T.StructType([T.StructField("chunk", T.BinaryType()), T.StructField("number", T.LongType()), T.StructField("rows", T.BinaryType())])

    def packed(part: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(part)
        return sink.getvalue().to_pybytes()

    def run(batches):
        for name, made in _packs(batches, packed):
            for number, rows in enumerate(made):
                yield batch_of(out, {"chunk": [name], "number": [number], "rows": [rows]})

    return docs.mapInArrow(run, out)


def _unpacked(table: pa.Table, name, columns: list[int] | None = None) -> list[pa.RecordBatch]:
    """The slices of one pack, with some of their columns or all."""
    rows = dict(zip(table.column("number").to_pylist(), table.column("rows"), strict=True))
    if not rows or sorted(rows) != list(range(table.num_rows)):
        raise RuntimeError(f"{table.num_rows} slices of the pack {name}: the scan of the documents does not repeat")
    options = pa.ipc.IpcReadOptions(included_fields=columns)
    return [pa.ipc.open_stream(rows[i].as_buffer(), options=options).read_all().combine_chunks().to_batches()[0] for i in range(len(rows))]


def _triggers(docs: DataFrame, buckets: int) -> DataFrame:
    """Per pack and group of buckets: triggers, which of them two texts have, and how many each bucket has."""
    out = _packed("bucket", "chunk triggers twice counts")
    step = _together(buckets)

    def run(batches):
        for name, parsed in _packs(batches, _parsed):
            found = _sorted(parsed, buckets)
            bounds = np.searchsorted(found.bucket, np.arange(buckets + step + 1))
            full = [b for b in range(0, buckets, step) if bounds[b] < bounds[b + step]]
            spans = [slice(bounds[b], bounds[b + step]) for b in full]
            yield batch_of(out, {
                "bucket": [b // step for b in full], "chunk": [name] * len(full), "triggers": [found.value[s].tobytes() for s in spans],
                "twice": [np.packbits(found.twice[s]).tobytes() for s in spans],
                "counts": [np.diff(bounds[b:b + step + 1]).astype(np.uint32).tobytes() for b in full],
            })

    return docs.mapInArrow(run, out)


def _company(key, part: pd.DataFrame) -> pd.DataFrame:
    """One group of buckets, in the order of each row: bits for triggers that occur in two texts, then bits for several phrases."""
    triggers = [np.frombuffer(x, _U) for x in part["triggers"]]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)).astype(bool) for x, t in zip(part["twice"], triggers, strict=True)]
    counts = np.stack([np.frombuffer(x, np.uint32) for x in part["counts"]]).astype(np.int64)
    ends = np.cumsum(counts, axis=1)
    flags = [np.zeros((2, len(t)), bool) for t in triggers]
    for b in range(counts.shape[1]):
        spans = [slice(x, y) for x, y in zip((ends - counts)[:, b].tolist(), ends[:, b].tolist(), strict=True)]
        trigger = np.concatenate([t[s] for t, s in zip(triggers, spans, strict=True)])
        if not len(trigger):
            continue
        order = np.argsort(trigger)
        value, owner = trigger[order], np.repeat(np.arange(len(triggers)), counts[:, b])[order]
        two = np.concatenate([t[s] for t, s in zip(twice, spans, strict=True)])[order]
        begin = np.flatnonzero(np.concatenate([[True], value[1:] >> _U(40) != value[:-1] >> _U(40)]))
        size = np.diff(np.append(begin, len(value)))
        shared = (np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)) | np.logical_or.reduceat(two, begin)
        several = value[begin] != value[begin + size - 1]
        found = np.zeros((2, len(trigger)), bool)
        found[0, order], found[1, order] = np.repeat(shared, size), np.repeat(shared & several, size)
        at = 0
        for f, s in zip(flags, spans, strict=True):
            f[:, s] = found[:, at:at + s.stop - s.start]
            at += s.stop - s.start
    return pd.DataFrame({"bucket": key[0], "chunk": part["chunk"], "triggers": [np.packbits(f).tobytes() for f in flags]})


def _squeeze(*columns: np.ndarray | bytes) -> bytes:
    """Columns compressed together; of numbers all first bytes, then all second ones, and so on."""
    raw = [c if isinstance(c, bytes) else np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return np.array([len(r) for r in raw], np.int64).tobytes() + pa.compress(b"".join(raw), "zstd", asbytes=True)


def _expand(value: bytes, *kinds: type) -> list:
    sizes = np.frombuffer(value, np.int64, len(kinds)).tolist()
    raw, at, out = pa.decompress(value[8 * len(kinds):], sum(sizes), "zstd", asbytes=True), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        part = raw[at:at + size]
        at += size
        out.append(part if kind is bytes else np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel())
    return out


def _steps(value: np.ndarray) -> np.ndarray:
    """Differences, to be summed up again in the same type."""
    return np.diff(value, prepend=value.dtype.type(0))


#: What a pack tells a group of buckets: numbers of occurrences, plain copies and texts of each bucket; of each occurrence
#: the doc_id, text, place in it and phrase; digests and spans of the plain copies, lengths and bytes of the texts.
_TOLD = (np.uint32, np.int64, np.uint32, np.uint32, np.uint32, _U, np.uint8, np.uint8, bytes)
#: What it gets back: texts, first bytes and lengths of ranges.
_BACK = (np.uint32, np.uint32, np.uint32)


def _phrases(parts: list[pa.RecordBatch], name: bytes, answers: pa.Table, buckets: int, out: T.StructType) -> pa.Table:
    """One pack: the distinct phrases with company by group of buckets, and where each occurs; all compressed."""
    step = _together(buckets)
    found = _sorted([_parsed(p) for p in parts], buckets)
    groups = np.searchsorted(found.bucket, np.arange(0, buckets + step, step))
    bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("triggers").to_pylist(), strict=True))
    flags = [np.unpackbits(np.frombuffer(bits[g], np.uint8), count=2 * n).reshape(2, -1) for g, n in enumerate(np.diff(groups).tolist()) if n]
    shared, several = np.concatenate(flags, axis=1).astype(bool) if flags else np.zeros((2, 0), bool)
    # Occurrences by bucket, in the order of the texts.
    kept = np.flatnonzero(shared[found.entry])
    entry, phrase = found.entry[kept], found.order[kept]
    order = np.argsort(found.bucket[entry].astype(_U) << _U(32) | phrase.astype(_U))
    entry, phrase = entry[order], phrase[order]
    bounds = np.searchsorted(found.bucket[entry], np.arange(buckets + step + 1))
    # Entries by bucket, plain copies before texts, in the order of their first occurrences.
    mine = np.flatnonzero(shared)
    key = (2 * found.bucket[mine] + several[mine]).astype(_U) << _U(32) | found.first[mine].astype(_U)
    order = np.argsort(key)
    mine, key = mine[order], key[order] >> _U(32)
    cuts = np.searchsorted(key, np.arange(2 * (buckets + step) + 1, dtype=_U))
    number = np.zeros(len(shared), np.int64)
    number[mine] = np.arange(len(mine))
    which = (number[entry] - cuts[2 * found.bucket[entry]]).astype(np.uint32)
    text, start = found.text[phrase], found.start[phrase]
    ids = np.concatenate([p.column("_id").fill_null(0).to_numpy() for p in parts])[text]
    flats = [flat(p.column("_text")) for p in parts]
    raw = b"".join(data for data, _ in flats)
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(offsets) for _, offsets in flats]))])
    first, whole = found.first[mine], several[mine]
    spans, digest = found.spans[first], found.digest[mine]
    begin = at[found.text[first]] + found.start[first]
    length = spans + np.uint8(SPAN - 1)
    cols: dict[str, list] = {f.name: [] for f in out.fields}
    for b in range(0, buckets, step):
        x, y = int(bounds[b]), int(bounds[b + step])
        if x == y:
            continue
        e = slice(int(cuts[2 * b]), int(cuts[2 * (b + step)]))
        w = whole[e]
        counts = np.column_stack([np.diff(bounds[b:b + step + 1]), np.diff(cuts[2 * b:2 * (b + step) + 1]).reshape(-1, 2)])
        texts = b"".join([raw[i:j] for i, j in zip(begin[e][w].tolist(), (begin[e][w] + length[e][w]).tolist(), strict=True)])
        cols["bucket"].append(b // step)
        cols["chunk"].append(name)
        cols["told"].append(_squeeze(
            counts.astype(np.uint32), _steps(ids[x:y]), _steps(text[x:y]), start[x:y], _steps(which[x:y]),
            digest[e][~w], spans[e][~w], length[e][w], texts))
    return pa.Table.from_batches([batch_of(out, cols)])


def span_ranks(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The suffix array of a dictionary as ranks: equal for spans that are equal, in the order of their bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
    value = np.zeros(n, _U)
    for i in range(8):
        value = value << _U(8) | padded[i:i + n].astype(_U)
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    # Ranks of 16, 32 and 50 bytes: the pair of the ranks of the two parts.
    for size, step in ((16, 8), (32, 16), (SPAN, SPAN - 32)):
        other = np.append(rank, np.zeros(step, np.int64))[step:step + n]
        pair = rank << 32 | other
        rank = np.unique(pair[place] if size == SPAN else pair, return_inverse=True)[1].astype(np.int64)
    return rank


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _covered(part: pd.DataFrame) -> pd.DataFrame:
    """One group of buckets: per pack the byte ranges of its texts that smaller documents hold too."""
    counts, doc, text, start, which, digest, spans, length, raw = zip(*[_expand(x, *_TOLD) for x in part["told"]], strict=True)
    counts = np.stack([c.reshape(-1, 3) for c in counts]).astype(np.int64)
    ends = np.cumsum(counts, axis=1)
    doc, text, which = ([np.cumsum(x, dtype=x.dtype) for x in xs] for xs in (doc, text, which))
    reach = [np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in length]
    found = []
    for b in range(counts.shape[1]):
        if not counts[:, b, 0].any():
            continue
        n, plain, whole = counts[:, b].T
        edges = [list(zip((ends - counts)[:, b, i].tolist(), ends[:, b, i].tolist(), strict=True)) for i in range(3)]
        take = lambda xs, i: np.concatenate([x[s:e] for x, (s, e) in zip(xs, edges[i], strict=True)])  # noqa: B023, E731
        # The dictionary of all packs: digests of plain copies, then texts.
        key, copy = np.unique(take(digest, 1), return_inverse=True)
        phrases: dict[bytes, int] = {}
        texts = [phrases.setdefault(r[x:y], len(phrases)) for r, at, (s, e) in zip(raw, reach, edges[2], strict=True) if s < e for x, y in zip(at[s:e].tolist(), at[s + 1:e + 1].tolist(), strict=True)]
        size = np.zeros(len(key) + len(phrases), np.int64)
        size[copy] = take(spans, 1)
        size[len(key):] = [len(p) - SPAN + 1 for p in phrases]
        at = np.cumsum(plain + whole) - plain - whole
        number = np.zeros(int((plain + whole).sum()), np.int64)
        number[_runs(at, plain)] = copy
        number[_runs(at + plain, whole)] = np.array(texts, np.int64) + len(key)
        # The parse, and the smallest document of each phrase of the dictionary.
        entry = number[take(which, 0) + np.repeat(at, n)]
        owner, own, row, place = take(doc, 0), take(text, 0), np.repeat(np.arange(len(part)), n), take(start, 0).astype(np.int64)
        least = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, owner)
        seen = np.flatnonzero((entry < len(key)) & (owner > least[entry]))
        found.append((row[seen], own[seen], place[seen], size[entry[seen]] + SPAN - 1))
        if phrases:
            smallest, first = _smallest(list(phrases), size[len(key):], least[len(key):])
            told = np.flatnonzero(entry >= len(key))
            for some in np.split(told, range(BLOCK, len(told), BLOCK)):
                found.append(_ranges(row[some], own[some], place[some], owner[some], first[entry[some] - len(key)], size[entry[some]], smallest))
    out: dict[str, list] = {"chunk": [], "back": []}
    row, own, begin, length = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, own, begin, length = row[order], own[order], begin[order], length[order]
    cuts = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if x < y:
            order = np.argsort(own[x:y].astype(_U) << _U(32) | begin[x:y].astype(_U))
            out["chunk"].append(part["chunk"].iloc[i])
            out["back"].append(_squeeze(_steps(own[x:y][order]), begin[x:y][order].astype(np.uint32), length[x:y][order].astype(np.uint32)))
    return pd.DataFrame(out)


def _smallest(phrases: list[bytes], spans: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each span of phrases that came as texts, and where the spans of each phrase begin.

    Phrases that share their trigger with another may share spans, so they go into the suffix array.
    """
    smallest = np.repeat(least, spans)
    length = spans + SPAN - 1
    data = np.frombuffer(b"".join(phrases), np.uint8)
    rank = span_ranks(data, _runs(np.cumsum(length) - length, spans))
    order = np.lexsort((smallest, rank))
    ranked = rank[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    smallest[order] = np.repeat(smallest[order[begin]], np.diff(np.append(begin, len(order))))
    return smallest, np.cumsum(spans) - spans


def _ranges(row: np.ndarray, text: np.ndarray, start: np.ndarray, doc: np.ndarray, first: np.ndarray, spans: np.ndarray, smallest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, text, first byte and length of what smaller documents hold, of occurrences in the order of their texts."""
    seen = np.repeat(doc, spans) > smallest[_runs(first, spans)]
    which, place = np.repeat(np.arange(len(row)), spans)[seen], _runs(start, spans)[seen]
    row, text = row[which], text[which]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    return row[begin], text[begin], place[begin], np.diff(np.append(begin, len(row))) + SPAN - 1


def union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
    return begin[new], reach[last]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and spans (begin, end in bytes, flat)."""
    added = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())),
    ]
    kept = [c for c in docs.columns if c not in {f.name for f in added} | {"_id", "_text"}]
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *[c for c in kept if c != text])
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    phrase_schema = _packed("bucket", "chunk told")
    out_schema = T.StructType([*[docs.schema[c] for c in kept], *added])

    def phrases(key, answers: pa.Table, packed: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _none(phrase_schema)
        name = answers.column("chunk")[0].as_py()
        return _phrases(_unpacked(packed, name, [0, 1]), name, answers, buckets, phrase_schema)

    def finish(key, packed: pa.Table, found: pa.Table) -> pa.Table:
        return _finished(_unpacked(packed, key), found, kept, text, out_schema)

    # One exchange of the slices serves both cogroups, as they share its plan.
    packs = _packed_slices(rows).groupBy("chunk")
    answered = _triggers(rows, buckets).groupBy("bucket").applyInPandas(_company, _packed("bucket", "chunk triggers"))
    found = answered.groupBy("chunk").cogroup(packs).applyInArrow(phrases, phrase_schema)
    covered = found.groupBy("bucket").applyInPandas(lambda part: _covered(part), "chunk binary, back binary")
    return packs.cogroup(covered.groupBy("chunk")).applyInArrow(finish, out_schema)


def _none(schema: T.StructType) -> pa.Table:
    return pa.Table.from_batches([batch_of(schema, {f.name: [] for f in schema.fields})])


def _finished(parts: list[pa.RecordBatch], found: pa.Table, kept: list[str], text: str, schema: T.StructType) -> pa.Table:
    """One pack with the results of its texts."""
    back = [_expand(x, *_BACK) for x in found.column("back").to_pylist()]
    places, begins, lengths = map(np.concatenate, zip(*back, strict=True)) if back else np.zeros((3, 0), np.uint32)
    places = np.concatenate([np.cumsum(x, dtype=np.uint32) for x, _, _ in back]) if back else places
    # Texts are laid out so far apart that no ranges of two of them touch.
    begins = places.astype(np.int64) << 33 | begins
    begins, ends = union(begins, begins + lengths)
    rows, out = 0, []
    for part in parts:
        bounds = np.searchsorted(begins, np.arange(rows, rows + part.num_rows + 1) << 33)
        data, offsets = flat(part.column("_text"))
        raw = data.tobytes()
        cols = {"n_bytes": np.diff(offsets), "n_removed": [], "n_spans": np.diff(bounds), "kept_sha256": [], "spans": []}
        for i in range(part.num_rows):
            begin, end = begins[bounds[i]:bounds[i + 1]] - (rows + i << 33), ends[bounds[i]:bounds[i + 1]] - (rows + i << 33)
            low, high = int(offsets[i]), int(offsets[i + 1])
            left, at = hashlib.sha256(), low
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                left.update(raw[at:low + x])
                at = low + y
            left.update(raw[at:high])
            cols["n_removed"].append(int((end - begin).sum()))
            cols["kept_sha256"].append(left.hexdigest())
            cols["spans"].append(np.stack([begin, end], 1).ravel())
        rows += part.num_rows
        out.append(batch_of(schema, {c: part.column("_text" if c == text else c) for c in kept} | cols))
    return pa.Table.from_batches(out)
