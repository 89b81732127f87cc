"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of word shingles that must all occur, in place, in a document. Its shingles are ordered
by how often they occur in all documents; as nothing may be missing, one necessary prefix token is enough: the rarest
shingle. Documents look up their shingles among these tokens, the place of the shingle in the window fixes where the
window would begin (positional bound), the text must hold all its words (length bound), and what is left is compared
word by word, byte by byte.

Items are taken in blocks of bounded size, each a broadcast; documents pass through one map per block and keep their
rows, so nothing is shuffled and the result does not depend on the number of blocks.

Defined results: null and empty texts have no words and no hit; an item without words, or with a null id, takes no
part; equal items count each; an empty table on either side gives no hit; input columns that have the name of a new
one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm import words as W
from postlake.llm.arrow import batch_of, flat, map_slices, slices
from postlake.session import scratch_path

WINDOW = 13
SHINGLE = 3
#: Bytes of item texts in one block; a block is what a task holds at once.
BLOCK_BYTES = 4 << 20
#: Blocks that one job holds; beyond, the marked rows are written and read again.
BLOCKS_AT_ONCE = 4
#: Possible matches, and bytes of matches, that are compared at once.
PAIRS_AT_ONCE, BYTES_AT_ONCE = 1 << 17, 1 << 20


class Index(NamedTuple):
    """The windows of one block of items, in the order of their prefix tokens."""

    token: np.ndarray     # hash of the rarest shingle
    size: np.ndarray      # words of that shingle
    offset: np.ndarray    # its place in the window
    begin: np.ndarray     # first word of the window among the block's words
    length: np.ndarray    # words of the window
    owner_at: np.ndarray  # where the window's items begin in ``owners`` (n + 1)
    owners: np.ndarray    # positions in ``names``
    names: list[str]
    words: W.Words


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes add up to about ``limit``, or single ones."""
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(int(np.searchsorted(total, before + limit, "right")), start + 1)
        yield slice(start, end)
        start = end


def item_words(texts: list[str | None]) -> W.Words:
    return W.split(*flat(pa.array(texts, pa.large_string())))


def item_shingles(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, size and first word of every shingle of the items; a shorter item is one shingle."""
    hashes, sizes, at = [], [], []
    count = np.diff(words.first)
    for size in range(1, SHINGLE + 1):
        all_of = W.shingles(words.hash, size)
        keep = np.repeat(count >= SHINGLE if size == SHINGLE else count == size, count)[:len(all_of)]
        keep &= W.whole(words.first, size, len(all_of))
        place = np.flatnonzero(keep)
        hashes.append(all_of[place])
        at.append(place)
        sizes.append(np.full(len(place), size))
    return np.concatenate(hashes), np.concatenate(sizes), np.concatenate(at)


def build(names: list[str], texts: list[str | None], rarity: dict[int, int]) -> Index:
    """``rarity``: how often each shingle occurs in all documents; 0 if it is not listed."""
    words = item_words(texts)
    count = np.diff(words.first)
    length = np.minimum(count, WINDOW)
    per_item = np.where(count > 0, count - length + 1, 0)
    item = np.repeat(np.arange(len(texts)), per_item)
    begin = _runs(words.first[:-1], per_item)
    length = length[item]
    hashes, sizes, at = item_shingles(words)
    by_word = np.zeros(len(words.hash), np.uint64)
    by_word[at] = hashes
    often = np.zeros(len(words.hash), np.int64)
    often[at] = [rarity.get(h, 0) for h in hashes.tolist()]
    size = np.minimum(length, SHINGLE)
    # The rarest shingle of each window; ties go to the smaller hash, so that equal windows take the same one.
    best, offset = np.full(len(begin), -1, np.int64), np.zeros(len(begin), np.int64)
    for o in range(WINDOW):
        fits = np.flatnonzero(o + size <= length)
        here, chosen = begin[fits] + o, begin[fits] + np.maximum(best[fits], 0)
        better = (best[fits] < 0) | (often[here] < often[chosen]) | (often[here] == often[chosen]) & (by_word[here] < by_word[chosen])
        best[fits[better]] = o
    offset = best
    # Equal windows are one entry with several items.
    signature = [words.text(int(b), int(b + n)) for b, n in zip(begin, length, strict=True)]
    entry: dict[bytes, int] = {}
    number = np.array([entry.setdefault(s, len(entry)) for s in signature], np.int64)
    _, lead = np.unique(number, return_index=True)
    token = by_word[(begin + offset)[lead]] if len(lead) else np.zeros(0, np.uint64)
    order = np.argsort(token, kind="stable")
    place = np.empty(len(lead), np.int64)
    place[order] = np.arange(len(lead))
    pairs = np.unique(np.stack([place[number], item]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
    lead = lead[order]
    return Index(
        token[order], size[lead], offset[lead], begin[lead], length[lead], np.searchsorted(pairs[0], np.arange(len(lead) + 1)), pairs[1],
        names, words,
    )


def matches(index: Index, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of the match, window) for every occurrence of a window in the texts."""
    where, which = [], []
    n = len(words.hash)
    for size in np.unique(index.size).tolist():
        entries = np.flatnonzero(index.size == size)
        tokens = index.token[entries]
        have = W.shingles(words.hash, size)
        low = np.searchsorted(tokens, have)
        spot = np.flatnonzero(tokens[np.minimum(low, len(tokens) - 1)] == have)
        spot = spot[W.whole(words.first, size, len(have))[spot]]
        many = np.searchsorted(tokens, have[spot], "right") - low[spot]
        for part in _pieces(many, PAIRS_AT_ONCE):
            begin, entry = _verified(index, words, np.repeat(spot[part], many[part]), entries[_runs(low[spot[part]], many[part])])
            where.append(begin)
            which.append(entry)
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(which)


def _verified(index: Index, words: W.Words, where: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those (place of the prefix token, window) whose window stands there, by its first word."""
    begin = where - index.offset[which]
    text = np.searchsorted(words.first, where, "right") - 1
    fits = (begin >= words.first[text]) & (begin + index.length[which] <= words.first[text + 1])
    begin, which = begin[fits], which[fits]
    for j in range(WINDOW):
        inside = j < index.length[which]
        same = ~inside
        same[inside] = words.hash[begin[inside] + j] == index.words.hash[index.begin[which[inside]] + j]
        begin, which = begin[same], which[same]
    size = words.end[begin + index.length[which] - 1] - words.start[begin]
    exact = [_exact(index, words, begin[part], which[part]) for part in _pieces(size, BYTES_AT_ONCE)]
    if not exact:
        return begin, which
    return np.concatenate([b for b, _ in exact]), np.concatenate([w for _, w in exact])


def _exact(index: Index, words: W.Words, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose words are equal byte by byte."""
    count = index.length[which]
    mine, theirs = _runs(begin, count), _runs(index.begin[which], count)
    size, same = words.end[mine] - words.start[mine], index.words.end[theirs] - index.words.start[theirs]
    fine = size == same
    size = np.minimum(size, same)
    equal = words.lower[_runs(words.start[mine], size)] == index.words.lower[_runs(index.words.start[theirs], size)]
    wrong = np.zeros(len(mine) + 1, np.int64)
    np.cumsum(np.add.reduceat(~equal, np.cumsum(size) - size, dtype=np.int64) + ~fine if len(mine) else wrong[1:], out=wrong[1:])
    ends = np.cumsum(count)
    ok = wrong[ends] == wrong[ends - count]
    return begin[ok], which[ok]


def covered(spans: np.ndarray) -> int:
    """Numbers inside the union of (begin, end) pairs, given flat."""
    if not len(spans):
        return 0
    pairs = spans.reshape(-1, 2)[np.argsort(spans[::2], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    before = np.concatenate([[pairs[0, 0]], reach[:-1]])
    return int(np.maximum(reach - np.maximum(pairs[:, 0], before), 0).sum())


def rarities(docs: DataFrame, text: str, wanted: np.ndarray) -> dict[int, int]:
    """How often the wanted shingles (those of one block) occur in all documents; summed in tasks, then by key."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])
    known = docs.sparkSession.sparkContext.broadcast(np.unique(wanted))

    def run(batches):
        tokens = known.value
        total = np.zeros(len(tokens), np.int64)
        for part in (p for batch in batches for p in slices(batch, text)):
            words = W.split(*flat(part.column(text)))
            for size in range(1, SHINGLE + 1):
                have = W.shingles(words.hash, size)
                have = have[W.whole(words.first, size, len(have))]
                at = np.minimum(np.searchsorted(tokens, have), max(len(tokens) - 1, 0))
                if len(tokens):
                    total += np.bincount(at[tokens[at] == have], minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield batch_of(schema, {"shingle": tokens[seen].view(np.int64), "n": total[seen]})

    found = docs.select(text).mapInArrow(run, schema).groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    keys = np.array(found.column("shingle").to_numpy(), np.int64).view(np.uint64).tolist()
    return dict(zip(keys, found.column("n").to_pylist(), strict=True))


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> list[DataFrame]:
    """The items in blocks of about ``limit`` bytes, and of one item at least.

    Repeated rows count once, and rows are dealt by id *and* text, so the rows of one id, however many, spread over all
    blocks; its hits meet again in ``_step``, which goes by the id.
    """
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).filter("name is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > limit:
        rows = rows.distinct()
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    n = max(1, -(-total // limit))
    return [rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, n_hit, n_items, items_sha256, contaminated and item_ids."""
    spark = docs.sparkSession
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("_spans", T.ArrayType(T.LongType())),
    ]
    kept = [c for c in docs.columns if c not in {f.name for f in added}]
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])
    out = docs.select(kept)
    for number, block in enumerate(blocks(items, item_id, item_text, block_bytes)):
        table = block.toArrow()
        names, texts = table.column("name").to_pylist(), table.column("text").to_pylist()
        wanted = item_shingles(item_words(texts))[0]
        index = spark.sparkContext.broadcast(build(names, texts, rarities(docs, text, wanted)))
        if number and number % BLOCKS_AT_ONCE == 0:
            path = scratch_path(spark, "decontaminate")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
        out = map_slices(out, text, schema, _step(index, kept, text, schema))
    return out.drop("_spans")


def _step(index, kept: list[str], text: str, schema: T.StructType):
    """Adds the hits of one block to what earlier blocks have found."""

    def make():
        block: Index = index.value

        def step(part: pa.RecordBatch):
            words = W.split(*flat(part.column(text)))
            begin, which = matches(block, words)
            end, order = begin + block.length[which], np.argsort(begin, kind="stable")
            begin, end, which = begin[order], end[order], which[order]
            bounds = np.searchsorted(begin, words.first)
            earlier = "_spans" in part.schema.names
            spans_before = part.column("_spans").to_pylist() if earlier else None
            items_before = part.column("item_ids").to_pylist() if earlier else None
            cols = {"n_words": np.diff(words.first), "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "item_ids": [], "_spans": []}
            for i, n in enumerate(cols["n_words"].tolist()):
                a, b = bounds[i], bounds[i + 1]
                spans = np.stack([begin[a:b], end[a:b]], 1).ravel() - words.first[i]
                owners = {block.names[o] for w in np.unique(which[a:b]).tolist() for o in block.owners[block.owner_at[w]:block.owner_at[w + 1]].tolist()}
                if earlier:
                    spans = np.concatenate([np.array(spans_before[i], np.int64), spans])
                    owners.update(items_before[i])
                hit, listed = covered(spans), sorted(owners)
                cols["n_hit"].append(hit)
                cols["n_items"].append(len(listed))
                cols["items_sha256"].append(hashlib.sha256(",".join(listed).encode()).hexdigest())
                cols["contaminated"].append(hit > 0 and 20 * hit >= n)
                cols["item_ids"].append(listed)
                cols["_spans"].append(spans)
            yield batch_of(schema, {c: part.column(c) for c in kept} | cols)

        return step

    return make
