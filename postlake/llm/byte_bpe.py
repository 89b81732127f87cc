"""Byte-level byte-pair encoding and decoding in two tiers.

First tier: a minimal perfect hash over the vocabulary tells, for whole arrays of pre-tokens, which of them are a token
as they stand. Second tier: the others are merged from their bytes, linked to their neighbours, with a heap of the
adjacent pairs: the lowest rank leaves first, the leftmost of equal ones, and stale entries are passed over.

Defined results: null and empty texts have no token; texts and pre-tokens are never cut; equal rows give equal results;
an empty table gives an empty table; columns of the input that have the name of a new one are replaced.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from postlake.llm.arrow import batch_of, map_slices
from postlake.llm.words import mix, stream

_U = np.uint64
_BYTE, _PLACE = stream(11, 256), stream(12, 1 << 12) | _U(1)
#: Keys of a bucket of the perfect hash, on average.
BUCKET = 4
#: Characters of pre-tokens that a task remembers with their tokens.
CACHE_CHARS = 6_000_000


def hashes(pieces: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each non-empty byte string."""
    length = np.array([len(p) for p in pieces], np.int64)
    if not len(length):
        return np.zeros(0, _U)
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE[flat] * _PLACE[place & 0xFFF], at) + length.astype(_U) + _U(seed) * _U(0x9E3779B97F4A7C15))


class PerfectHash(NamedTuple):
    """n keys to n slots without a gap: the bucket of a key holds a displacement, or the slot itself."""

    seed: int
    n: int
    shift: np.ndarray   # per bucket: displacement, or -1 - slot where the bucket has one key

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        return self.of(hashes(pieces, self.seed))

    def of(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % _U(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, displaced(h, np.maximum(shift, 0), self.n))


def displaced(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h ^ (shift.astype(_U) * _U(0xD6E8FEB86659FD93))) % _U(n)).astype(np.int64)


def perfect_hash(keys: list[bytes]) -> PerfectHash:
    """Large buckets first look for a displacement that sends all their keys to free slots; single keys take what is left."""
    n = len(keys)
    seed = 0
    while len(np.unique(h := hashes(keys, seed))) < n:
        seed += 1
    shift = np.zeros(n // BUCKET + 1, np.int64)
    bucket = (h % _U(len(shift))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=len(shift))
    start = np.cumsum(size) - size
    taken = np.zeros(n, bool)
    by_size = np.argsort(-size, kind="stable")
    for b in by_size[size[by_size] > 1].tolist():
        mine, tried = h[order[start[b]:start[b] + size[b]]], 0
        while True:
            some = np.arange(tried, tried + 64)
            slots = displaced(mine, some[:, None], n)
            free = ~taken[slots].any(axis=1)
            for i in np.flatnonzero(free).tolist():
                if len(set(slots[i].tolist())) == len(mine):
                    shift[b] = some[i]
                    taken[slots[i]] = True
                    break
            else:
                tried += 64
                continue
            break
    alone = np.flatnonzero(size == 1)
    shift[alone] = -1 - np.flatnonzero(~taken)
    return PerfectHash(seed, n, shift)


class Model(NamedTuple):
    """A vocabulary; its size is that of the rank file, whatever the corpus."""

    tokens: list[bytes]       # by id; empty where no token has the id
    longest: int
    index: PerfectHash
    slot_id: np.ndarray       # id of the token in each slot
    byte_id: np.ndarray       # id of each single byte
    byte_pair: np.ndarray     # rank of two bytes side by side, -1 without one
    pattern: str
    unlike: dict[int, str]    # characters that the library's own tables sort otherwise, with a stand-in of that sort


def load(path: str, pattern: str) -> Model:
    """A rank file: a base64 token and its rank in each line. Single bytes have to be tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    keys = list(ranks)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    index = perfect_hash(keys)
    slot_id = np.zeros(len(keys), np.int64)
    slot_id[index.slots(keys)] = list(ranks.values())
    pair = np.full((256, 256), -1, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            pair[token[0], token[1]] = rank
    return Model(
        tokens, max(map(len, keys)), index, slot_id,
        np.array([ranks[bytes([b])] for b in range(256)], np.int64), pair, pattern, other_tables(ranks),
    )


def other_tables(ranks: dict[bytes, int]) -> dict[int, str]:
    """Letters and numbers where the tables of two Unicode versions differ: those of the ``tiktoken`` library hold.

    They are asked for once, on the driver; without that library the tables of ``regex`` hold.
    """
    try:
        import tiktoken
    except ModuleNotFoundError:
        return {}
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out: dict[int, str] = {}
    for sort, sign in ((r"\p{L}", "x"), (r"\p{N}", "0")):
        ask = tiktoken.Encoding("sort", pat_str=sort, mergeable_ranks=ranks, special_tokens={})
        theirs, ours = set(ask.decode(ask.encode_ordinary(every))), set(regex.findall(sort, every))
        out |= {ord(c): "!" for c in ours - theirs if ord(c) not in out} | {ord(c): sign for c in theirs - ours}
    return out


class Encoder:
    """Encodes texts; remembers the tokens of the pre-tokens seen before, within a bound."""

    def __init__(self, model: Model):
        self.model, self.cut = model, regex.compile(model.pattern)
        spans, at = [], sorted(model.unlike)
        for c in at:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        self.unlike = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]") if spans else None
        self.rank_of = {t: i for i, t in enumerate(model.tokens) if t}
        self.numbers = [str(i) for i in range(len(model.tokens))]
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, in order."""
        if self.unlike is None or text.isascii() or not self.unlike.search(text):
            return self.cut.findall(text)
        return [text[m.start():m.end()] for m in self.cut.finditer(text.translate(self.model.unlike))]

    def known(self, pieces: list[bytes]) -> list[int]:
        """First tier: the id of each piece that is a token, else -1."""
        model = self.model
        ids = model.slot_id[model.index.slots(pieces)].tolist() if pieces else []
        return [i if model.tokens[i] == p else -1 for i, p in zip(ids, pieces, strict=True)]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Second tier: the bytes of each piece, merged pair by pair; all pieces stand in one row of linked bytes."""
        model, size = self.model, np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(size)
        first = np.append(model.byte_pair[raw[:-1], raw[1:]], -1)
        first[ends - 1] = -1
        at = np.flatnonzero(first >= 0)
        entries, bound = (first[at] << 32 | at).tolist(), np.searchsorted(at, np.append(0, ends)).tolist()
        # rank[i]: that of the pair which begins at byte i; -1 if it has none or byte i begins no symbol any more
        symbols, rank = model.byte_id[raw].tolist(), first.tolist()
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        tokens, rank_of, pairs = model.tokens, self.rank_of, self.pairs
        out, begin = [], 0
        for piece, end in enumerate(ends.tolist()):
            heap = entries[bound[piece]:bound[piece + 1]]
            heapify(heap)
            while heap:
                top = heappop(heap)
                made, i = top >> 32, top & 0xFFFFFFFF
                if rank[i] != made:
                    continue
                gone = after[i]
                symbols[i], symbols[gone], rank[gone] = made, -1, -1
                following = after[i] = after[gone]
                if following < end:
                    before[following] = i
                    key = made << 32 | symbols[following]
                    if key not in pairs:
                        pairs[key] = rank_of.get(tokens[made] + tokens[symbols[following]], -1)
                    found = rank[i] = pairs[key]
                    if found >= 0:
                        heappush(heap, found << 32 | i)
                else:
                    rank[i] = -1
                left = before[i]
                if left >= begin:
                    key = symbols[left] << 32 | made
                    if key not in pairs:
                        pairs[key] = rank_of.get(tokens[symbols[left]] + tokens[made], -1)
                    found = rank[left] = pairs[key]
                    if found >= 0:
                        heappush(heap, found << 32 | left)
            out.append([s for s in symbols[begin:end] if s >= 0])
            begin = end
        return out

    def learn(self, fresh: list[str]) -> None:
        raw, longest, numbers, tokens = [p.encode() for p in fresh], self.model.longest, self.numbers, self.model.tokens
        ids = dict(zip(small := [b for b in raw if len(b) <= longest], self.known(small), strict=True))
        missing = [b for b in raw if ids.get(b, -1) < 0]
        parts = iter(self.merge(missing))
        for piece, b in zip(fresh, raw, strict=True):
            i = ids.get(b, -1)
            if i >= 0:
                self.ids[piece], self.decoded[piece] = numbers[i], tokens[i]
            else:
                part = next(parts)
                self.ids[piece] = " ".join([numbers[i] for i in part])
                self.decoded[piece] = b"".join([tokens[i] for i in part])
        self.held += sum(map(len, raw)) + 4 * len(raw)

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Per text its ids, joined by one space, and the bytes that they decode to."""
        if self.held > CACHE_CHARS or len(self.pairs) > CACHE_CHARS:
            self.forget()
        found = [self.pieces(t) for t in texts]
        self.learn(list(set().union(*found) - self.ids.keys()))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [(" ".join(map(ids, p)), b"".join(map(decoded, p))) for p in found]


def _run(docs: DataFrame, path: str, pattern: str, text: str, keep: tuple[str, ...], new: list, finish) -> DataFrame:
    schema = T.StructType([*[docs.schema[c] for c in keep if c not in {f.name for f in new}], *new])
    model = docs.sparkSession.sparkContext.broadcast(load(path, pattern))

    def make():
        gc.disable()  # nothing here forms cycles, and the search for them would walk the remembered pieces
        encoder = Encoder(model.value)

        def step(part: pa.RecordBatch):
            got = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield batch_of(schema, {c: part.column(c) for c in keep} | finish(got))

        return step

    return map_slices(docs.select(*dict.fromkeys([*keep, text])), text, schema, make)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the token ids of every row.

    ``path`` names a rank file that the driver can read and ``pattern`` the expression that cuts a text into pre-tokens;
    the model goes to the tasks as a broadcast of that file's size.
    """
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return _run(docs, path, pattern, text, keep, new, lambda got: {"ids": [list(map(int, a.split())) for a, _ in got]})


def decode(coded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes that a row of ids stands for, as ``decoded``; null ids decode to nothing."""
    schema = T.StructType([*[coded.schema[c] for c in keep if c != "decoded"], T.StructField("decoded", T.BinaryType())])
    tokens = coded.sparkSession.sparkContext.broadcast(load(path, "").tokens)

    def run(batches):
        known = tokens.value
        for part in batches:
            made = [b"".join([known[i] for i in row or []]) for row in part.column(ids).to_pylist()]
            yield batch_of(schema, {c: part.column(c) for c in keep} | {"decoded": made})

    return coded.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode`` and ``decode``, with the number of ids and SHA-256 digests of the ids and of the decoded bytes."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def finish(got):
        return {
            "n_tokens": [a.count(" ") + 1 if a else 0 for a, _ in got],
            "ids_sha256": [hashlib.sha256(a.encode()).hexdigest() for a, _ in got],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in got],
        }

    return _run(docs, path, pattern, text, keep, new, finish)
