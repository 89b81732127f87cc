"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles. Equal sets are one class. Classes are split recursively: a run samples tokens
(coordinates of a MinHash signature), classes that share one stand in one bucket, a bucket of more than ``SMALL``
classes is split again by tokens sampled for its path, and a small one is searched by brute force over signatures. Runs
repeat so that two sets at the threshold fail to meet with less than one chance in a million. What is still large
after ``DEPTH`` levels counts as one group. Groups of classes that met are compared exactly, on their whole sets, in
pairs of blocks of bounded size; pairs are counted, never emitted.

Defined results: a text of fewer words than a shingle is one shingle of all its words; null, empty and wordless texts
have no link; rows that are equal link to each other; a null doc_id takes part, and a group's id is its least doc_id;
an empty table gives an empty table; input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm import words as W
from postlake.llm.arrow import batch_of, flat, map_slices
from postlake.llm.components import components, stored, stored_light

SHINGLE = 5
#: Jaccard threshold as a fraction.
OVER, UNDER = 4, 5
#: Tokens sampled of a set, runs, tokens that a node splits on, levels.
TOKENS, RUNS, SPLIT, DEPTH = 64, 6, 2, 4
#: Classes in a bucket that is searched at once, and tokens that two classes must share there to be compared exactly.
SMALL, ALIKE = 64, 30
#: Classes in a block of the exact comparison.
BLOCK = 256
_MULTIPLY, _ADD = W.stream(21, TOKENS) | np.uint64(1), W.stream(22, TOKENS)
_KEY = W.stream(23, 2)


def text_shingles(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and where each text's begin (n + 1)."""
    count = np.diff(words.first)
    full = W.shingles(words.hash, SHINGLE)
    found, owner = [], []
    text = np.repeat(np.arange(len(count)), count)
    ok = np.flatnonzero(W.whole(words.first, SHINGLE, len(full)))
    found.append(full[ok])
    owner.append(text[ok])
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        if len(short):
            found.append(W.shingles(words.hash, size)[words.first[short]])
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(count)))])


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(first) - 1))])


def _reduce(operation, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text; texts without shingles give 0."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.diff(first) > 0
    if full.any():
        out[full] = operation.reduceat(values, first[:-1][full])
    return out


def keys(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that stand for the whole set."""
    parts = [W.mix(_reduce(np.add, W.mix(hashes ^ k), first) + np.diff(first).astype(np.uint64)) for k in _KEY]
    return [row.tobytes() for row in np.stack(parts, 1)]


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, TOKENS), np.uint32)
    for t in range(TOKENS):
        out[:, t] = _reduce(np.minimum, (hashes * _MULTIPLY[t] + _ADD[t]) >> np.uint64(32), first).astype(np.uint32)
    return out


def describe(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row with words: id, row digest, key and size of its set, signature."""
    schema = T.StructType([
        T.StructField("id", docs.schema[doc_id].dataType), T.StructField("row", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType()),
    ])

    def make():
        def step(part: pa.RecordBatch):
            hashes, first = distinct(*text_shingles(W.split(*flat(part.column("text")))))
            full = np.flatnonzero(np.diff(first) > 0)
            key, signature = keys(hashes, first), signatures(hashes, first)
            chosen = part.take(pa.array(full))
            yield batch_of(schema, {
                "id": chosen.column("id"), "row": chosen.column("row"), "key": [key[i] for i in full], "n": np.diff(first)[full],
                "signature": [signature[i].tobytes() for i in full],
            })

        return step

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return map_slices(rows, "text", schema, make)


_PATHS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("path", T.LongType())])


def split(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, signature, path) to rows (key, path) one level down. At level 0 the path is the run."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            # The tokens that a node splits on are drawn for its path; they differ from each other.
            start = W.mix(path + np.uint64(level)) % np.uint64(TOKENS) if level else path * np.uint64(SPLIT)
            stride = (W.mix(path ^ _KEY[0]) % np.uint64(TOKENS // 2)) * np.uint64(2) + np.uint64(1) if level else np.ones(len(path), np.uint64)
            for s in range(SPLIT):
                token = (start + stride * np.uint64(s)) % np.uint64(TOKENS)
                value = tokens[np.arange(len(path)), token.astype(np.int64)]
                below = W.mix(W.mix(path + np.uint64(1 + level)) ^ W.mix(value + (token << np.uint64(32))))
                yield batch_of(_PATHS, {"key": batch.column("key"), "path": below.view(np.int64)})

    return rows.select("key", "signature", "path").mapInArrow(run, _PATHS)


def brute_force(rows: DataFrame) -> DataFrame:
    """Rows (path, key, signature) of small buckets, each bucket in one partition and in order, to links (a, b)."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def links(table: pa.Table):
        path, key = table.column("path").to_numpy(), table.column("key").to_pylist()
        tokens = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, TOKENS)
        begin = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        end = np.append(begin[1:], len(path))
        label = np.arange(len(path))
        left, right = [], []
        # Pairs at a distance of 1, 2, ... rows inside one bucket.
        bound = np.repeat(end, end - begin)
        for gap in range(1, int((end - begin).max())):
            a = np.flatnonzero(np.arange(len(path)) + gap < bound)
            a = a[(tokens[a] == tokens[a + gap]).sum(1) >= ALIKE]
            left.append(a)
            right.append(a + gap)
        if not left:
            return
        left, right = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(path)))
        if len(moved):
            yield batch_of(schema, {"a": [key[i] for i in moved], "b": [key[i] for i in label[moved]]})

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last bucket may go on in the next batch.
            path = batch.column("path").to_numpy()
            cut = int(np.searchsorted(path, path[-1]))
            if cut:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column("path")[-1].as_py() != path[0]:
                yield from links(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    return rows.repartition("path").sortWithinPartitions("path").select("path", "key", "signature").mapInArrow(run, schema)


def met(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that met on a chosen path and look alike there."""
    narrow = classes.select("key", "signature")
    rows = narrow.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RUNS - 1).cast("long"))))
    small, left = [], None
    for level in range(DEPTH):
        # The paths of a class differ from each other, but for a chance of 2^-64; it would meet itself there.
        paths = stored(split(rows, level), "paths")
        sizes = stored_light(paths.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("least")).filter("size > 1"), "path-sizes")
        if level == DEPTH - 1:
            small.append(paths.join(sizes.filter(F.col("size") <= SMALL), "path").select("path", "key"))
            left = paths.join(sizes.filter(F.col("size") > SMALL), "path").filter("key != least")
            break
        inside = stored_light(paths.join(sizes, "path"), "shared-paths")
        small.append(inside.filter(F.col("size") <= SMALL).select("path", "key"))
        rows = stored_light(inside.filter(F.col("size") > SMALL).select("path", "key").join(narrow, "key"), "large-buckets")
        if rows.isEmpty():
            break
    # The small buckets of all levels are searched together.
    links = brute_force(reduce(DataFrame.unionByName, small).join(narrow, "key"))
    return links if left is None else links.unionByName(left.select(F.col("key").alias("a"), F.col("least").alias("b")))


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """The whole shingle sets of the wanted classes (key, id, row, ...), one row each."""
    schema = T.StructType([*[f for f in wanted.schema.fields if f.name not in ("id", "row")], T.StructField("shingles", T.BinaryType())])
    kept = [f.name for f in schema.fields if f.name != "shingles"]
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))
    rows = rows.join(wanted, rows["_id"].eqNullSafe(wanted["id"]) & (rows["_row"] == wanted["row"])).select("_text", *kept)

    def make():
        def step(part: pa.RecordBatch):
            hashes, first = distinct(*text_shingles(W.split(*flat(part.column("_text")))))
            yield batch_of(schema, {c: part.column(c) for c in kept} | {"shingles": [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]})

        return step

    return map_slices(rows, "_text", schema, make).dropDuplicates(["key"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of bounded slices of the incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    rank = np.cumsum(often > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.diag([len(s) for s in sets]).astype(np.float64)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        matrix = np.zeros((n, 2048), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        product = matrix @ matrix.T
        np.fill_diagonal(product, 0)
        out += product
    return out


def compare(part: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
    """Exact links of one group between its blocks i and j: per class the linked documents, and one link to hold it."""
    sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
    size, copies, block, key = part["n"].to_numpy(), part["copies"].to_numpy(), part["block"].to_numpy(), part["key"].to_numpy()
    common = overlaps(sets)
    # I / (a + b - I) >= 4 / 5
    linked = (OVER + UNDER) * common >= OVER * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    label = np.arange(len(part))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(part)).min(1, initial=len(part)))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"key": key, "links": links.astype(np.int64), "to": key[label]})


def exact(members: DataFrame) -> DataFrame:
    """members (component, size, key, n, copies, shingles) -> rows (key, links, to), several per class."""
    total = members.count()
    bins = max(1, total // 1024)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key"), blocks).cast("int")
    # A small group shares a bin with others; a large one is a grid of pairs of blocks.
    rows = members.withColumns({"blocks": blocks, "block": block}).withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    grid = rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        done = [compare(group, key[1], key[2]) for _, group in part.groupby("component", sort=False)]
        return pd.concat(done)

    return grid.select("bin", "i", "j", "component", "key", "n", "copies", "block", "shingles").groupBy("bin", "i", "j").applyInPandas(run, "key binary, links long, to binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, row (digest of the text), class_id (least doc_id of its group), first (id and row of that one), n_links."""
    rows = stored(describe(docs, doc_id, text), "sets")
    least = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    equal = rows.groupBy("key").agg(F.min(least).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    equal = stored_light(equal, "classes")
    groups = components(met(equal))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    wanted = groups.join(stored_light(sizes, "group-sizes"), "component").join(equal, groups["node"] == equal["key"])
    wanted = wanted.select("component", "size", "key", "n", "copies", F.col("first.id").alias("id"), F.col("first.row").alias("row"))
    found = stored(exact(stored(_sets(docs, doc_id, text, wanted), "group-sets")), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    named = equal.select("key", "copies", "first").join(links, "key", "left").join(linked.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "first", F.coalesce("component", "key").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = stored_light(named, "named")
    heads = stored_light(named.groupBy("component").agg(F.min("first").alias("head")), "heads")
    named = stored_light(named.join(heads, "component").select("key", "head", "n_links"), "class-heads")
    mine = rows.select("id", "row", "key").join(named, "key")
    return mine.select("id", "row", F.col("head.id").alias("class_id"), F.col("head").alias("first"), "n_links")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its doc_id, class_id and number of links; rows without words come with no link."""
    rows = classes(docs, doc_id, text)
    found = rows.select(F.col("id").alias(doc_id), "class_id", "n_links")
    empty = docs.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return found.unionByName(empty.select(doc_id, F.col(doc_id).alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the first of each group of linked rows."""
    rows = classes(docs, doc_id, text)
    mine = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    gone = rows.filter(F.col("n_links") > 0).select(F.col("id").alias("_pl_id"), F.col("row").alias("_pl_digest"), (mine != F.col("first")).alias("_pl_gone")).distinct()
    keyed = docs.withColumn("_pl_row", F.xxhash64(text))
    on = keyed[doc_id].eqNullSafe(F.col("_pl_id")) & (F.col("_pl_row") == F.col("_pl_digest"))
    marked = keyed.join(stored_light(gone, "later-copies"), on, "left")
    single = marked.filter(F.col("_pl_gone").isNull()).select(docs.columns)
    # Rows that are equal even in doc_id: one of them stays.
    heads = marked.filter(~F.col("_pl_gone")).dropDuplicates([doc_id, "_pl_row"]).select(docs.columns)
    return single.unionByName(heads)
