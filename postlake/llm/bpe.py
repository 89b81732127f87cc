"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of neighbouring symbols of a word, each with its merge rank; the root is the
leftmost pair of the lowest rank. A merge changes three leaves and their ancestors, and merging ends when the root
holds no rank. Many words are merged side by side: one row of a matrix holds the tree of one word.

Defined results: null and empty texts have no token; texts are never cut; equal rows give equal results; an empty
table gives an empty table; columns of the input that have the name of a new one are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from postlake.llm.arrow import batch_of, map_slices

_NONE = np.int64(1) << 62
#: Words of more symbols have a tree of their own.
WIDE = 64
#: Characters of words that a task remembers with their tokens.
CACHE_CHARS = 6_000_000
_WORD = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"\s+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


class Model(NamedTuple):
    """A vocabulary as arrays; its size is that of the tokenizer file, whatever the corpus."""

    tokens: list[str]
    inner: np.ndarray      # symbol of each byte
    last: np.ndarray       # symbol of each byte at a word's end
    keys: np.ndarray       # left << 32 | right, sorted
    ranks: np.ndarray      # rank of each key
    merged: np.ndarray     # symbol that rank r makes
    special: dict[str, int]


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def load(path: str) -> Model:
    """A byte-level BPE tokenizer file with a suffix at the end of words, lower case and no white space."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = [""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in [*vocabulary.items(), *special.items()]:
        tokens[i] = token
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    signs = byte_characters()
    return Model(
        tokens, np.array([vocabulary[c] for c in signs], np.int64), np.array([vocabulary[c + suffix] for c in signs], np.int64),
        keys[order], order.astype(np.int64), np.array([vocabulary[a + b] for a, b in pairs], np.int64), special,
    )


def pair_ranks(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair, or the mark of none."""
    key = left << 32 | right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    return np.where(model.keys[at] == key, model.ranks[at], _NONE)


def merge_rows(model: Model, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge one word per row; ``symbols`` is as wide as a power of two. Returns symbols and which are left."""
    n, width = symbols.shape
    place = np.arange(width)
    alive = place < length[:, None]
    after = np.where(place + 1 < length[:, None], place + 1, width)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), _NONE, np.int64)
    if width > 1:
        pair = alive[:, 1:]
        rank = np.full((n, width - 1), _NONE, np.int64)
        rank[pair] = pair_ranks(model, symbols[:, :-1][pair], symbols[:, 1:][pair])
        tree[:, width:-1] = np.where(rank < _NONE, rank << 32 | place[:-1], _NONE)
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < _NONE)

    def lift(rows, leaf):
        node = leaf + width
        while True:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            if node[0] == 1:
                return

    while len(rows):
        root = tree[rows, 1]
        at, made = root & 0xFFFFFFFF, model.merged[root >> 32]
        gone = after[rows, at]
        following = after[rows, gone]
        symbols[rows, at] = made
        alive[rows, gone] = False
        after[rows, at] = following
        tree[rows, gone + width] = _NONE
        tree[rows, at + width] = _NONE
        lift(rows, gone)
        more = following < width
        r, a, f = rows[more], at[more], following[more]
        if len(r):
            before[r, f] = a
            rank = pair_ranks(model, made[more], symbols[r, f])
            tree[r, a + width] = np.where(rank < _NONE, rank << 32 | a, _NONE)
        lift(rows, at)
        left = before[rows, at]
        more = left >= 0
        r, p = rows[more], left[more]
        if len(r):
            rank = pair_ranks(model, symbols[r, p], made[more])
            tree[r, p + width] = np.where(rank < _NONE, rank << 32 | p, _NONE)
            lift(r, p)
        rows = rows[tree[rows, 1] < _NONE]
    return symbols, alive


def merge_long(model: Model, symbols: list[int]) -> list[int]:
    """The same tree for one long word, in plain lists."""
    n, width = len(symbols), 1 << max(1, (len(symbols) - 1).bit_length())
    none = int(_NONE)
    array = np.array(symbols, np.int64)
    rank = pair_ranks(model, array[:-1], array[1:])
    leaves = np.where(rank < _NONE, rank << 32 | np.arange(n - 1), _NONE).tolist()
    tree = [none] * width + leaves + [none] * (width - len(leaves))
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    known: dict[int, int] = {}

    def put(leaf: int, left: int, right: int) -> None:
        value = none
        if right >= 0:
            key = symbols[left] << 32 | symbols[right]
            if key not in known:
                known[key] = int(pair_ranks(model, np.array([symbols[left]]), np.array([symbols[right]]))[0])
            value = none if known[key] == none else known[key] << 32 | leaf
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] < none:
        at, made = tree[1] & 0xFFFFFFFF, int(model.merged[tree[1] >> 32])
        gone = after[at]
        symbols[at], alive[gone] = made, False
        after[at] = after[gone]
        if after[at] >= 0:
            before[after[at]] = at
        put(gone, gone, -1)
        put(at, at, after[at])
        if before[at] >= 0:
            put(before[at], before[at], at)
    return [s for s, left in zip(symbols, alive, strict=True) if left]


def encode_words(model: Model, words: list[str]) -> tuple[list[int], list[int]]:
    """All tokens in one list, and where those of each word begin (n + 1 places); trees of one width side by side."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(b) for b in raw], np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for width in (2, 4, 8, 16, 32, WIDE):
        members = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for lo in range(0, len(members), 1 << 14):
            part = members[lo:lo + (1 << 14)]
            flat = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in part.tolist()]), np.uint8).reshape(-1, width)
            symbols, end = model.inner[flat], (np.arange(len(part)), sizes[part] - 1)
            symbols[end] = model.last[flat[end]]
            symbols, alive = merge_rows(model, symbols, sizes[part])
            found.append((part, alive.sum(1), symbols[alive]))
    for i in np.flatnonzero(sizes > WIDE).tolist():
        symbols = model.inner[np.frombuffer(raw[i], np.uint8)].tolist()
        symbols[-1] = int(model.last[raw[i][-1]])
        symbols = merge_long(model, symbols)
        found.append((np.array([i]), np.array([len(symbols)]), np.array(symbols, np.int64)))
    counts = np.zeros(len(words) + 1, np.int64)
    for part, n, _ in found:
        counts[part + 1] = n
    starts = np.cumsum(counts)
    out = np.zeros(int(starts[-1]), np.int64)
    for part, n, ids in found:
        at = np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(len(ids))
        out[at] = ids
    return out.tolist(), starts.tolist()


def _runs(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    # str.split also splits at four control characters that are no white space here.
    return [r for r in _SPACE.split(text) if r] if _SEPARATORS.search(text) else text.split()


class Encoder:
    """Encodes texts; remembers the tokens of the runs between white space seen before, within a bound."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, [str(i) for i in range(len(model.tokens))]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.forget()

    def forget(self) -> None:
        self.ids, self.names, self.held = {}, {}, 0

    def runs(self, text: str) -> list:
        """What stands between white space, normalized, in order; a special token's own text is given as a tuple."""
        if self.cut is None or not any(s in text for s in self.model.special):
            return _runs(text)
        out = []
        for part in self.cut.split(text):
            out += [(part,)] if part in self.model.special else _runs(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text its ids and its tokens, each joined by one space (this vocabulary's decoder joins so)."""
        if self.held > CACHE_CHARS:
            self.forget()
        runs = [self.runs(t) for t in texts]
        fresh = list(set().union(*runs) - self.ids.keys())
        self.held += sum(map(len, fresh)) + 4 * len(fresh)
        words = [_WORD.findall(r) if isinstance(r, str) else [] for r in fresh]
        distinct = list(set().union(*words))
        flat, starts = encode_words(self.model, distinct)
        numbers, tokens = [self.numbers[i] for i in flat], [self.model.tokens[i] for i in flat]
        spans = list(zip(starts, starts[1:], strict=False))
        ids = dict(zip(distinct, [" ".join(numbers[a:b]) for a, b in spans], strict=True))
        names = dict(zip(distinct, [" ".join(tokens[a:b]) for a, b in spans], strict=True))
        for run, parts in zip(fresh, words, strict=True):
            if isinstance(run, tuple):
                self.ids[run], self.names[run] = str(self.model.special[run[0]]), run[0]
            elif len(parts) == 1:
                self.ids[run], self.names[run] = ids[parts[0]], names[parts[0]]
            else:
                self.ids[run], self.names[run] = " ".join([ids[p] for p in parts]), " ".join([names[p] for p in parts])
        ids, names = self.ids.__getitem__, self.names.__getitem__
        return [(" ".join(map(ids, r)), " ".join(map(names, r))) for r in runs]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns of ``keep``, its token ids and the text that they decode to.

    ``tokenizer`` names a file that the driver can read; the model goes to the tasks as a broadcast of that file's size.
    """
    schema = T.StructType([
        *[docs.schema[c] for c in keep], T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType()),
    ])
    model = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def make():
        gc.disable()  # nothing here forms cycles, and the search for them would walk the remembered words
        encoder = Encoder(model.value)

        def step(part: pa.RecordBatch):
            got = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield batch_of(schema, {c: part.column(c) for c in keep} | {"ids": [a for a, _ in got], "decoded": [b for _, b in got]})

        return step

    return map_slices(docs.select(*dict.fromkeys([*keep, text])), text, schema, make)


def digests(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode``, with the number of ids and SHA-256 digests in place of the texts."""
    schema = T.StructType([
        *[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    model = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def make():
        gc.disable()  # nothing here forms cycles, and the search for them would walk the remembered words
        encoder = Encoder(model.value)

        def step(part: pa.RecordBatch):
            got = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield batch_of(schema, {c: part.column(c) for c in keep} | {
                "n_tokens": [a.count(" ") + 1 if a else 0 for a, _ in got],
                "ids_sha256": [hashlib.sha256(a.encode()).hexdigest() for a, _ in got],
                "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for _, b in got],
            })

        return step

    return map_slices(docs.select(*dict.fromkeys([*keep, text])), text, schema, make)
