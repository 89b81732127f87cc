"""The battery of randomness tests against plain arithmetic, the discovery rule against all chances, and recall."""

from __future__ import annotations

import math
import random

from postlake.llm import secrets as S
from pyspark.sql import functions as F


def plain(enc: str, value: str) -> tuple[float, float, float, float]:
    alphabet = S._ALPHABETS[enc]
    body = value.rstrip("=")
    body = body.lower() if enc == "hex" else body.translate(str.maketrans("-_", "+/"))
    codes, k = [alphabet.index(c) for c in body], len(alphabet)
    n = len(codes)
    parts = min(int((n / S.EXPECTED - 1) // 2) * 2 + 1, S.PARTS, (k - 1) // 2 * 2 + 1)
    of = [c * parts // k for c in range(k)]
    chi = 0.0
    for i in range(parts):
        want = n * of.count(i) / k
        chi += (sum(of[c] == i for c in codes) - want) ** 2 / want
    uniform = min(1.0, math.exp(-chi / 2) * sum((chi / 2) ** i / math.factorial(i) for i in range((parts - 1) // 2)))
    middle = (k - 1) / 2
    changes = sum((a > middle) != (b > middle) for a, b in zip(codes, codes[1:]))
    m, low = n - 1, min(changes, n - 1 - changes)
    if m <= S.EXACT:
        runs = min(1.0, 2 * sum(math.comb(m, i) for i in range(low + 1)) / 2**m)
    else:
        runs = min(1.0, math.erfc((abs(changes - m / 2) - 0.5) / math.sqrt(m / 4) / math.sqrt(2)))
    serial = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / ((k * k - 1) / 12) / math.sqrt(m)
    three = [max(x, 1e-300) for x in (uniform, runs, math.erfc(abs(serial) / math.sqrt(2)))]
    half = -sum(map(math.log, three))
    return *three, math.exp(-half) * (1 + half + half * half / 2)


def tokens(seed: int, each: int, lengths=(20, 24, 33, 64, 128, 700)):
    rnd = random.Random(seed)
    return [(e, n, "".join(rnd.choice(a) for _ in range(n))) for e, a in S._ALPHABETS.items() for n in lengths for _ in range(each)]


def test_chances(spark):
    rows = tokens(1, 6) + [("hex", 0, x) for x in ("0123456789abcdef" * 3, "a" * 40, "ABCDEF" * 5)] + [("base64", 0, x) for x in ("some_long_identifier_of_version_2", "a-b" * 12 + "==")]
    got = spark.createDataFrame(rows, "e string, n int, v string").select("e", "v", S.chances(F.col("e"), F.col("v")).alias("c")).collect()
    for r in got:
        want = plain(r.e, r.v)
        for a, b in zip(r.c, want):
            assert abs(a - b) <= 1e-5 * b + 1e-290, (r.e, r.v, tuple(r.c), want)


def test_random_tokens_keep_to_their_chances(spark):
    """Of random tokens about a twentieth has a combined chance below 0.05, in every encoding, short and long."""
    rows = spark.createDataFrame(tokens(2, 100, (20, 32, 100)), "e string, n int, v string")
    seen = rows.select("e", "n", S.chances(F.col("e"), F.col("v"))["all"].alias("p")).groupBy("e").agg(
        F.avg((F.col("p") < 0.05).cast("int")).alias("a"), F.avg((F.col("p") < 0.01).cast("int")).alias("b"), F.min("p").alias("least")).collect()
    assert len(seen) == 4 and all(r.a < 0.12 and r.b < 0.05 and r.least > 1e-7 for r in seen), seen


def test_rule_over_bins():
    """Against Benjamini and Hochberg's rule over the single chances, each taken at the edge of its bin."""
    rnd = random.Random(3)
    for _ in range(200):
        chances = [math.exp(-rnd.choice([rnd.random() * 3, rnd.random() * 30])) for _ in range(rnd.randrange(1, 60))]
        bins: dict[int, int] = {}
        for p in chances:
            b = min(int(-math.log(p) // S.BIN_WIDTH), S.BINS)
            bins[b] = bins.get(b, 0) + 1
        edges = sorted(math.exp(-min(int(-math.log(p) // S.BIN_WIDTH), S.BINS) * S.BIN_WIDTH) for p in chances)
        most = max((i for i, p in enumerate(edges, 1) if p <= S.FALSE_DISCOVERY * i / len(edges)), default=0)
        found = S.lowest_bin(bins)
        assert sum(n for b, n in bins.items() if found is not None and b >= found) == most


def test_recall_and_structure(spark):
    """Random tokens of each encoding and length among ordinary long names: nearly all are reported, few names are."""
    rnd = random.Random(4)
    words = "account settings manager default connection handler internal service response value application message update controller".split()
    names = []
    for _ in range(300):
        picked = [rnd.choice(words) for _ in range(rnd.randrange(3, 7))]
        names.append(rnd.choice(["_".join, "/".join, lambda p: "".join(x.title() for x in p), "".join])(picked))
    names = [x for x in names if len(x) >= 20]
    rows = [(i, f"see {v} here", e) for i, (e, _, v) in enumerate(tokens(5, 40, (20, 32, 64, 128)))]
    rows += [(100_000 + i, f"see {v} here", "name") for i, v in enumerate(names)]
    found = S.scan(spark.createDataFrame(rows, "doc_id long, text string, e string"))
    share = {r.e: r.s for r in found.groupBy("e").agg(F.avg((F.col("n_random") > 0).cast("double")).alias("s")).collect()}
    assert all(share[e] >= 0.95 for e in S._ALPHABETS) and share["name"] <= 0.15, share


def test_ties_and_odd_rows(spark):
    """Equal tokens are judged alike wherever they stand; candidates of digits only have no encoding."""
    token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = [(1, token), (2, f"{token} {token}"), (3, "1" * 40), (4, None), (5, ""), (6, "-" * 30), (7, "=" * 30)]
    got = {r.doc_id: (r.n_random, r.spans) for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 8)] == [1, 2, 0, 0, 0, 0, 0]
    assert got[2][1] == "hex:0:40,random:0:40,hex:41:81,random:41:81"
