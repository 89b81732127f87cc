"""Fill-in-middle transformation with a learned rank index over line offsets.

The line offsets of a slice of texts are a rising function of the line number. Segments of straight lines are fitted to
*all* of them, as long as each can be within an error bound of every offset it covers, and what is left over is stored
as one small integer per offset. A cut is then worked out, not searched for: the segment of its line number predicts
the place and the stored residual corrects it exactly.

Two cuts make prefix, middle and suffix; the rearranged text can be turned back into the exact original (``restore``).

Defined results: null and empty texts are ``plain`` with no line; a text that holds one of the three marks is ``plain``;
texts are never cut short, a long one makes a slice of its own; a null id draws like the empty id; equal rows give equal
results; an empty table gives an empty table; columns of the input that have the name of a new one are replaced.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from postlake.llm.arrow import batch_of, flat, map_slices

NEW = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
]


class Settings(NamedTuple):
    """What is drawn and how it is written. ``fim`` and ``spm`` are percentages."""

    seed: int = 7
    fim: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: A prediction is at most this far from the offset, so that a residual fits into two bytes.
    error: int = 8191

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """The marks as bytes; two marks that may overlap could not be told apart again."""
        marks = tuple(m.encode() for m in (self.prefix, self.suffix, self.middle))
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError("the three marks must differ and must not overlap")
        return marks


class RankIndex(NamedTuple):
    """Offset of every rank: a straight line per segment plus a residual per rank."""

    first: np.ndarray      # first rank of each segment
    base: np.ndarray       # offset of that rank
    slope: np.ndarray      # offsets per rank
    residual: np.ndarray   # true less predicted offset, for every rank

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of some ranks."""
        return predict(self.first, self.base, self.slope, ranks) + self.residual[ranks]


def predict(first: np.ndarray, base: np.ndarray, slope: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    segment = np.searchsorted(first, ranks, "right") - 1
    return base[segment] + np.floor(slope[segment] * (ranks - first[segment])).astype(np.int64)


def fit(offsets: np.ndarray, error: int) -> RankIndex:
    """Grow each segment while some slope through its first offset is within ``error`` of all offsets."""
    n, at = len(offsets), 0
    first, slope = [], []
    while at < n:
        low, high, end, width = -np.inf, np.inf, at + 1, 64
        while end < n:
            stop = min(end + width, n)
            run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else stop - end
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            if end < stop:
                break
            width *= 2
        first.append(at)
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    firsts, slopes = np.array(first, np.int64), np.array(slope)
    residual = offsets - predict(firsts, offsets[firsts], slopes, np.arange(n))
    kind = np.int16 if error < 32_000 else np.int64
    return RankIndex(firsts, offsets[firsts], slopes, residual.astype(kind))


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on the id and the seed only."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def line_starts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line of all texts starts, the end of the last one, and per text (n + 1) its first line."""
    mark = np.zeros(len(buf) + 1, bool)
    mark[np.flatnonzero(buf == 10) + 1] = True
    mark[offsets] = True
    starts = np.flatnonzero(mark)
    return starts, np.searchsorted(starts, offsets)


def rearrange(form: str, parts: tuple[bytes, bytes, bytes], marks: tuple[bytes, bytes, bytes]) -> bytes:
    (prefix, middle, suffix), (p, s, m) = parts, marks
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes] = Settings().marks()) -> bytes:
    """The original text of a rearranged one."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    a = output.index(second, len(first))
    b = output.index(m, a + len(second))
    one, two, middle = output[len(first):a], output[a + len(second):b], output[b + len(m):]
    return one + middle + two if form == "psm" else two + middle + one


def cut_slice(part: pa.RecordBatch, text: str, doc_id: str, settings: Settings):
    """Per row: number of lines, form, code points of prefix and middle (None if plain), and the output."""
    marks = settings.marks()
    buf, offsets = flat(part.column(text))
    starts, rank = line_starts(buf, offsets)
    index = fit(starts, settings.error)
    drawn = [draws(d, settings.seed) for d in part.column(doc_id).to_pylist()]
    lines = np.diff(rank)
    pair = np.array([d[:2] for d in drawn], np.int64).reshape(-1, 2) % (lines[:, None] + 1)
    begin = index.locate(rank[:-1] + pair.min(axis=1)).tolist()
    finish = index.locate(rank[:-1] + pair.max(axis=1)).tolist()
    opens = (buf & 0xC0) != 0x80  # one byte of each code point
    whole = buf.tobytes()
    for i, (a, z, n) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), lines.tolist(), strict=True)):
        raw, (_, _, h3, h4) = whole[a:z], drawn[i]
        if not raw or any(m in raw for m in marks) or h3 % 100 >= settings.fim:
            yield n, "plain", None, None, raw
            continue
        b, c = begin[i], finish[i]
        form = "spm" if h4 % 100 < settings.spm else "psm"
        out = rearrange(form, (whole[a:b], whole[b:c], whole[c:z]), marks)
        yield n, form, int(np.count_nonzero(opens[a:b])), int(np.count_nonzero(opens[b:c])), out


def _run(docs: DataFrame, text: str, doc_id: str, settings: Settings, keep: tuple[str, ...], extra: list, finish) -> DataFrame:
    settings.marks()
    schema = T.StructType([*[docs.schema[c] for c in keep if c not in {f.name for f in [*NEW, *extra]}], *NEW, *extra])

    def make():
        def step(part: pa.RecordBatch):
            rows = list(cut_slice(part, text, doc_id, settings))
            new = {f.name: [r[i] for r in rows] for i, f in enumerate(NEW)}
            yield batch_of(schema, {c: part.column(c) for c in keep} | new | finish(rows))

        return step

    return map_slices(docs.select(*dict.fromkeys([*keep, doc_id, text])), text, schema, make)


def transform(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns of ``keep``, lines, form, code points of prefix and middle, and the rearranged text as ``output``."""
    extra = [T.StructField("output", T.StringType())]
    return _run(docs, text, doc_id, settings, keep, extra, lambda rows: {"output": [r[4].decode() for r in rows]})


def restored(cut: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The original ``text`` of every ``output`` and ``form``."""
    marks = settings.marks()
    schema = T.StructType([*[cut.schema[c] for c in keep if c != "text"], T.StructField("text", T.StringType())])

    def make():
        def step(part: pa.RecordBatch):
            pairs = zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)
            yield batch_of(schema, {c: part.column(c) for c in keep} | {"text": [restore(o.encode(), f, marks).decode() for o, f in pairs]})

        return step

    return map_slices(cut.select(*dict.fromkeys([*keep, "output", "form"])), "output", schema, make)


def digests(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """As ``transform``, with SHA-256 of the output and of the text rebuilt from it in place of the texts."""
    marks = settings.marks()
    extra = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]

    def finish(rows):
        return {
            "output_sha256": [hashlib.sha256(r[4]).hexdigest() for r in rows],
            "restored_sha256": [hashlib.sha256(restore(r[4], r[1], marks)).hexdigest() for r in rows],
        }

    return _run(docs, text, doc_id, settings, keep, extra, finish)
