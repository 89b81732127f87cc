"""Toxicity scores from subword-bag embeddings.

A word is the bag of its character n-grams and itself, hashed into a table of vectors; a text is the mean of its
words, and a linear softmax reads it. Table and softmax are trained together in numpy, on the driver, on a sample of
labelled rows whose bound is a parameter. A misspelt word shares n-grams with the words seen, and so their vectors.

As everything behind the table is linear, a word has one number (its part of the logit), and a text the mean of the
numbers of its words: scoring keeps a number per word and is exact over texts of any length.

Defined results: null, empty and wordless texts get the score of the bias alone; without labelled rows of both classes
every score is the share of the class that there is, or 0; labels of one document that differ count as toxic; an empty
table gives an empty table; input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm import words as W
from postlake.llm.arrow import batch_of, flat, map_slices

#: Labelled rows of class 0 and of class 1, at most, that the model is fitted to.
SAMPLE_ROWS = (4500, 1500)
BUCKETS, DIMENSIONS, GRAMS = 1 << 14, 8, (4, 5)
EPOCHS, BATCH, RATE, DECAY = 20, 256, 0.05, 1e-4
#: Blank words that each text carries beside its own, so that a handful of words is weak evidence.
BLANKS = 16
#: Words that a task remembers with their numbers.
CACHE_WORDS = 1 << 19
FOLDS = 5
_EDGE = W.stream(11, 2)


class Model(NamedTuple):
    part: np.ndarray   # per bucket: its part of the logit
    bias: float


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def word_grams(words: W.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the picked words, one after the other, and how many each word has."""
    start, size = words.start[pick], words.end[pick] - words.start[pick]
    padded = size + 2
    base = np.cumsum(padded) - padded
    # Each word's bytes between two edge marks.
    codes = np.zeros(int(padded.sum()), np.uint64)
    inner = np.repeat(base + 1, size) + _within(size)
    codes[inner] = W.mix(words.lower[np.repeat(start, size) + _within(size)].astype(np.uint64) + np.uint64(1))
    codes[base], codes[base + padded - 1] = _EDGE
    owner = np.repeat(np.arange(len(pick)), padded)
    left = np.repeat(base + padded, padded) - np.arange(len(codes))
    found, owners = [words.hash[pick]], [np.arange(len(pick))]
    for n in GRAMS:
        grams = W.shingles(codes, n)
        ok = np.flatnonzero(left[:len(grams)] >= n)
        found.append(grams[ok])
        owners.append(owner[ok])
    buckets, owners = (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(pick))


def _within(size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class Bags(NamedTuple):
    """The fit sample: per text the buckets that it has and its weight in each, times 1024 in half precision."""

    bucket: np.ndarray
    weight: np.ndarray
    offset: np.ndarray   # n + 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Some texts as rows of a matrix."""
        out = np.zeros((len(rows), BUCKETS), np.float32)
        size = self.offset[rows + 1] - self.offset[rows]
        at = np.repeat(self.offset[rows], size) + _within(size)
        out[np.repeat(np.arange(len(rows)), size), self.bucket[at]] = self.weight[at]
        return out


def bag(texts: pa.Array):
    """Per text its buckets, rising, and the mean over its words of a word's mean over its subwords."""
    words = W.split(*flat(texts))
    _, lead, word = np.unique(words.hash, return_index=True, return_inverse=True)
    buckets, count = word_grams(words, lead)
    at = np.cumsum(count) - count
    for i in range(len(texts)):
        mine, often = np.unique(word[words.first[i]:words.first[i + 1]], return_counts=True)
        n = count[mine]
        which = buckets[np.repeat(at[mine], n) + _within(n)]
        weight = np.bincount(which, np.repeat(1024 * often / n / (often.sum() + BLANKS), n), BUCKETS).astype(np.float16)
        full = np.flatnonzero(weight)
        yield full.astype(np.uint16), weight[full]


def train(x: Bags, y: np.ndarray) -> Model:
    """Fit vectors and softmax together by Adam on the cross entropy, in small batches; the seed is fixed."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float64), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(7)
    n = len(y)
    some = x.dense(np.arange(0, n, max(1, n // 256)))
    scale = np.float32(1 / max(np.sqrt((some * some).sum(1).mean()), 1e-9))
    params = [rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.stack([1 - y, y], 1).astype(np.float32)
    per_epoch = -(-n // BATCH)
    step, last = 0, EPOCHS * per_epoch
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            step += 1
            rows = order[lo:lo + BATCH]
            seen = x.dense(rows) * scale
            table, out, bias = params
            hidden = seen @ table
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[rows]) / len(rows)
            grads = [seen.T @ (error @ out.T) + DECAY * table, hidden.T @ error, error.sum(0)]
            rate = RATE * (1 - step / (last + 1))
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    table, out, bias = (p.astype(np.float64) for p in params)
    slope = out[:, 1] - out[:, 0]
    return Model(table @ slope * float(scale) * 1024, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded number of labelled rows of each class, chosen by a hash of their id."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    order = F.xxhash64("_id")
    sample = [known.filter(F.col("y") == y).orderBy(order, "_id").limit(SAMPLE_ROWS[y]) for y in (0, 1)]
    # At most sum(SAMPLE_ROWS) ids and labels.
    chosen = F.broadcast(sample[0].unionByName(sample[1]))
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    rows = texts.join(chosen, F.col("_doc") == F.col("_id")).select(order.alias("_order"), "_id", F.xxhash64("_text").alias("_hash"), "y", "_text")
    kept = ["_order", "_id", "_hash", "y"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("bucket", T.BinaryType()), T.StructField("weight", T.BinaryType())])

    def make():
        def step(part: pa.RecordBatch):
            made = [(b.tobytes(), w.tobytes()) for b, w in bag(part.column("_text"))]
            yield batch_of(schema, {c: part.column(c) for c in kept} | {"bucket": [b for b, _ in made], "weight": [w for _, w in made]})

        return step

    # Bags are made in tasks; one is at most four bytes a bucket, whatever the length of its text.
    bags = map_slices(rows, "_text", schema, make).orderBy("_order", "_id", "_hash").limit(sum(SAMPLE_ROWS))
    found = bags.select("y", "bucket", "weight").toArrow()
    bucket = np.frombuffer(b"".join(found.column("bucket").to_pylist()), np.uint16)
    weight = np.frombuffer(b"".join(found.column("weight").to_pylist()), np.float16)
    size = found.column("bucket").combine_chunks().cast(pa.large_binary())
    offset = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8) // 2 if len(size) else np.zeros(1, np.int64)
    y = found.column("y").to_numpy().astype(np.float64)
    del found, size
    pa.default_memory_pool().release_unused()
    return train(Bags(bucket, weight, offset - offset[0]), y)


class Scorer:
    """Numbers of words, remembered within a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def logits(self, texts: pa.Array) -> np.ndarray:
        words = W.split(*flat(texts))
        found, lead, word = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        have = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
        value = np.zeros(len(found))
        value[have] = self.values[at[have]]
        fresh = np.flatnonzero(~have)
        if len(fresh):
            buckets, count = word_grams(words, lead[fresh])
            value[fresh] = np.add.reduceat(self.model.part[buckets], np.cumsum(count) - count) / count
            if len(self.keys) + len(fresh) > CACHE_WORDS:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
            keys = np.concatenate([self.keys, found[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate([self.values, value[fresh]])[order]
        n = np.diff(words.first)
        # Sums over each text alone, so that a score does not depend on its neighbours.
        sums = np.zeros(len(n))
        full = n > 0
        if full.any():
            sums[full] = np.add.reduceat(value[word], words.first[:-1][full])
        return sums / (n + BLANKS) + self.model.bias


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with held_out, score and predicted."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text))
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])

    def make():
        scorer = Scorer(model.value)

        def step(part: pa.RecordBatch):
            logit = np.clip(scorer.logits(part.column(text)), -700, 700)
            p = 1 / (1 + np.exp(-logit))
            yield batch_of(schema, {c: part.column(c) for c in kept} | {"score": p, "predicted": (p >= 0.5).astype(np.int32)})

        return step

    return map_slices(docs.select(kept), text, schema, make).withColumn("held_out", held_out(doc_id))
