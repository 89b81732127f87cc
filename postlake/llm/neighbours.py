"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into blocks of bounded size; a block holds a forest: per tree one sorted array of long hash strings (the
sides of random hyperplanes through the mean of a sample). A query descends in every tree to its longest matching
prefix and then ascends in all trees at once, one character at a time, until the prefixes of that length hold the
wanted number of entries, all rows of one id counting as one; these candidates are compared exactly. Queries, in blocks too, visit every block of rows.

How many entries are wanted, as a share of a block, is fitted once on a bounded sample against brute force, so that the
sample's recall reaches ``TARGET``: little for vectors with structure, much for vectors that are all equally far apart.

Defined results: a vector that is null, zero, or holds null or a number that is not finite takes no part, nor does a row
without id; vectors of different length are never compared; rows of one id count once, the nearest first; a query never
finds its own id; ties go to the smaller id; fewer candidates than asked give fewer rows; an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

TREES, BITS = 16, 32
#: Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Rows of the sample that mean and share are fitted on, queries tried on it, and the recall it has to reach.
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET = 8192, 128, 0.97


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng(dimension).normal(size=(dimension, TREES * BITS))


class Forest:
    """Sorted arrays of hash strings over one block."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, ids: np.ndarray):
        self.ids = ids
        named, self.number, copies = np.unique(ids, return_inverse=True, return_counts=True)
        self.named = len(named)
        self.vectors, self.centre, self.planes = vectors, centre, planes(vectors.shape[1])
        self.norms = (vectors * vectors).sum(1)
        hashes = self.hashes(vectors)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.strings = np.take_along_axis(hashes, self.order, 1)
        # All rows of an id weigh 1 together, so a range never weighs more than it has ids.
        weights = (1 / copies)[self.number][self.order]
        self.sums = np.concatenate([np.zeros((TREES, 1)), np.cumsum(weights, axis=1)], axis=1)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """Per tree and vector one string of BITS signs, as a number."""
        sides = ((vectors - self.centre) @ self.planes > 0).reshape(len(vectors), TREES, BITS)
        return (sides * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(2, dtype=np.uint64).T

    def ranges(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, where in the sorted array the strings with the same prefix stand."""
        shift = np.uint64(BITS - length)
        low = (strings >> shift) << shift
        high = low + (np.uint64(1) << shift)
        return (np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, low, strict=True)]),
                np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, high, strict=True)]))

    def candidates(self, queries: np.ndarray, wanted: float) -> list[np.ndarray]:
        """Per query the rows below the longest common prefixes that hold ``wanted`` entries over all trees, an id counting once a tree."""
        strings = self.hashes(queries)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        left = np.arange(len(queries))
        for length in range(BITS, -1, -1):
            low, high = self.ranges(strings[:, left], length)
            weight = (np.take_along_axis(self.sums, high, 1) - np.take_along_axis(self.sums, low, 1)).sum(0)
            done = weight >= wanted if length else np.ones(len(left), bool)
            for i in np.flatnonzero(done).tolist():
                seen = np.zeros(len(self.vectors), bool)
                for t in range(TREES):
                    seen[self.order[t, low[t, i]:high[t, i]]] = True
                out[left[i]] = np.flatnonzero(seen)
            left = left[~done]
            if not len(left):
                break
        return out

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))

    def nearest(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of some rows, by exact distance and id; an id counts once."""
        rough = self.norms[rows] - 2 * (self.vectors[rows] @ query)
        if len(rows) > 4 * k:
            # Each id by its nearest row, before the ids are cut down; with room for rounding.
            room = 2e-9 * (self.norms[rows].max() + (query * query).sum())
            best = np.full(self.named, np.inf)
            np.minimum.at(best, self.number[rows], rough)
            edge = np.partition(best, 4 * k)[4 * k] if self.named > 4 * k else np.inf
            rows = rows[rough <= np.minimum(best[self.number[rows]], edge) + room]
        exact = self.distances(query, rows)
        order = np.lexsort((self.ids[rows], exact))
        _, lead = np.unique(self.ids[rows][order], return_index=True)
        order = order[np.sort(lead)][:k]
        return self.ids[rows][order], exact[order]


def least(k: int) -> int:
    """Entries over all trees that are sure to hold k ids besides the query's own."""
    return TREES * (k + 1)


def fit(vectors: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The mean of a sample with one row of each id, and the wanted entries per id of a block."""
    centre = vectors.mean(0)
    forest, n = Forest(vectors, centre, np.arange(len(vectors))), len(vectors)
    tried = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_QUERIES)).astype(int))
    truth = []
    for i in tried:
        d = forest.distances(vectors[i], np.arange(n))
        d[i] = np.inf
        truth.append(set(np.argsort(d, kind="stable")[:min(k, n - 1)].tolist()))
    total = sum(map(len, truth))
    share = 0.01
    while share < TREES:
        found = forest.candidates(vectors[tried], max(share * n, least(k)))
        hit = sum(len(t & set(c.tolist())) for t, c in zip(truth, found, strict=True))
        if hit >= TARGET * total:
            break
        share *= 1.3
    return centre, share


def search(table: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row that ``queries`` holds for, its k nearest rows: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("dimension", F.size("v"))
    counts = {r["dimension"]: (r["n"], r["nq"]) for r in rows.groupBy("dimension").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq")).collect()}
    schema = "query_id long, vec_id long, score double"
    fitted = {}
    for d in counts:
        own = rows.filter(F.col("dimension") == d)
        named = own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        once = own.join(F.broadcast(named), "id").groupBy("id").agg(F.min("v").alias("v"))
        sample = once.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE_ROWS).toArrow()
        flat = sample.column("v").combine_chunks().values.to_numpy(zero_copy_only=False)
        fitted[d] = fit(flat.reshape(-1, d), k)
    known = spark.sparkContext.broadcast(fitted)

    def visit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        centre, share = known.value[key[0]]
        vectors, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
        asked, names = np.stack(right["v"].to_numpy()), right["id"].to_numpy()
        forest = Forest(vectors, centre, ids)
        out = []
        for q, name, found in zip(asked, names, forest.candidates(asked, max(share * forest.named, least(k))), strict=True):
            near, score = forest.nearest(q, found[ids[found] != name], k) if len(found) else (found, found)
            out.append(pd.DataFrame({"query_id": np.full(len(near), name, np.int64), "vec_id": near.astype(np.int64), "score": score.astype(np.float64)}))
        return pd.concat(out)

    # Rows are dealt by their place in the scan, so that no value makes a block larger.
    parts = []
    for d, (n, nq) in counts.items():
        if nq:
            own = rows.filter(F.col("dimension") == d)
            blocks, asks = math.ceil(n / BLOCK_ROWS), math.ceil(nq / BLOCK_QUERIES)
            every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            block = own.select("dimension", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), every(asks).alias("ask"), "id", "v")
            query = own.filter("q").select("dimension", every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"), "id", "v")
            keys = ["dimension", "block", "ask"]
            parts.append(block.groupBy(keys).cogroup(query.groupBy(keys)).applyInPandas(visit, schema))
    found = spark.createDataFrame([], schema) if not parts else parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
