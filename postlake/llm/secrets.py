"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens. DataFrame functions only.

A candidate is a run of 20 or more characters of base-64 alphabets. Its encoding is the smallest alphabet that holds it
(hex, base 32, base 62, base 64). Three tests each give the chance of what is seen under a random draw from that alphabet:

* chi-squared of the counts in equal parts of the alphabet, as many parts as leave five characters expected in each; their
  number is odd, so the chance is a closed sum;
* runs above and below the middle of the alphabet, whose changes are binomial: summed exactly up to 600 characters;
* serial correlation of neighbours, by the normal law.

The three are combined by Fisher's rule, and the combined chances go through Benjamini and Hochberg's rule at
``FALSE_DISCOVERY`` within each encoding and class of length, over all documents: what it discovers is a token that is
*not* random, and of those at most that share are random ones. All other candidates are reported as random. The rule
works on counts in bins of equal width of the logarithm, so that what comes back from the documents is bounded.

Defined results: null and empty texts hold no secret; texts are read whole; equal rows, and candidates with equal
chances, give equal results; an empty table gives an empty table; input columns that have the name of a new one are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Share of random tokens among those that are found not to be random, at most.
FALSE_DISCOVERY = 0.01
#: Characters expected in each part of the alphabet, at least, and the most parts.
EXPECTED, PARTS = 5, 15
#: Changes that are summed exactly; more follow the normal law.
EXACT = 600
#: Bins of the logarithm of the chance: width and number.
BIN_WIDTH, BINS = 0.25, 240
LENGTHS = (32, 64, 128)
_ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points; value is a group of the pattern."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"))),
                      value, lambda a, v: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), v.alias("value")))
    kind = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(state, row):
        begin = state["at"] + row["gap"]
        end = begin + row["size"]
        item = F.struct(begin.alias("start"), end.alias("end"), row["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    found = F.aggregate(rows, start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _spans(matches: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    shown = F.transform(F.array_sort(spans), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def encoding(value: Column) -> Column:
    body = F.rtrim(value, F.lit("="))
    return (
        F.when(body.rlike("^[0-9]+$"), F.lit(None).cast("string")).when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )


def _erfc(z: Column) -> Column:
    """Complementary error function of z >= 0, by Chebyshev's fit with a relative error of 1.2e-7 everywhere."""
    t = 1 / (1 + z / 2)
    # Fixed values of the fit, from the highest power down.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    power = F.lit(0.0)
    for c in fit:
        power = power * t + c
    return t * F.exp(-z * z + power)


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / math.sqrt(2))


def _tail(half: Column, terms: Column) -> Column:
    """Chance of a chi-squared of 2 * ``terms`` degrees beyond 2 * ``half``: exp(-half) times the first terms of its series."""
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(
        F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>")), one,
        lambda s, i: F.struct((s["term"] * half / i).alias("term"), (s["sum"] + s["term"] * half / i).alias("sum")), lambda s: s["sum"],
    )
    return F.least(F.exp(-half) * series, F.lit(1.0))


def _binomial(n: Column, seen: Column) -> Column:
    """Two-sided chance of ``seen`` changes, or as few or many, among ``n`` that are as likely as not."""
    low = F.least(seen, n - seen)
    first = F.pow(F.lit(2.0), -n)
    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(low > 0, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))
    exact = F.aggregate(
        steps, start, lambda s, i: F.struct((s["term"] * (n - i + 1) / i).alias("term"), (s["sum"] + s["term"] * (n - i + 1) / i).alias("sum")), lambda s: s["sum"],
    )
    normal = _two_sided((F.abs(seen - n / 2) - 0.5) / F.sqrt(n / 4))
    return F.least(F.when(n <= EXACT, 2 * exact).otherwise(normal), F.lit(1.0))


def _bind(value: Column, body) -> Column:
    """``body`` over a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chances(encoding: Column, value: Column) -> Column:
    """The chances of the three tests under a random draw, and all of them combined."""
    body = F.rtrim(value, F.lit("="))
    plain = F.when(encoding == "hex", F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    alphabet = F.coalesce(*[F.when(encoding == name, F.lit(a)) for name, a in _ALPHABETS.items()])
    zero = F.lit(0.0)

    def with_codes(t: Column) -> Column:
        codes, k = t["codes"], t["k"]
        n = F.size(codes).cast("double")
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        # An odd number of parts, so that the degrees of freedom are even.
        parts = F.least(F.floor((n / EXPECTED - 1) / 2) * 2 + 1, F.lit(PARTS), F.floor((k - 1) / 2) * 2 + 1).cast("int")
        made = F.struct(codes.alias("codes"), k.alias("k"), n.alias("n"), parts.alias("parts"), pairs.alias("pairs"))
        return _bind(made, tested)

    def tested(t: Column) -> Column:
        codes, k, n, parts, pairs = (t[c] for c in ("codes", "k", "n", "parts", "pairs"))
        placed = F.array_sort(F.transform(codes, lambda c: F.floor(c * parts / k).cast("int")))
        # In order, so that the count of a part is the way from its first place to that of the next one.
        upto = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.size(F.filter(placed, lambda x: x <= i)).cast("double"))
        seen = F.zip_with(upto, F.concat(F.array(zero), F.slice(upto, 1, parts - 1)), lambda x, y: x - y)
        # The alphabet is not always divided evenly: a part expects as many characters as it holds.
        holds = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: n * (F.ceil((i + 1) * k / parts) - F.ceil(i * k / parts)) / k)
        chi = F.aggregate(F.zip_with(seen, holds, lambda o, e: (o - e) * (o - e) / e), zero, lambda total, x: total + x)
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        changes = F.aggregate(pairs, zero, lambda total, p: total + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
        serial = F.aggregate(pairs, zero, lambda total, p: total + (p["a"] - middle) * (p["b"] - middle)) / spread / F.sqrt(n - 1)
        return _bind(F.struct(n.alias("n"), parts.alias("parts"), (chi / 2).alias("half"), changes.alias("changes"), serial.alias("serial")), combined)

    def combined(t: Column) -> Column:
        least = F.lit(1e-300)
        uniform = F.greatest(_tail(t["half"], F.floor((t["parts"] - 1) / 2).cast("int")), least)
        three = F.struct(uniform.alias("uniform"), F.greatest(_binomial(t["n"] - 1, t["changes"]), least).alias("runs"), F.greatest(_two_sided(t["serial"]), least).alias("serial"))
        return _bind(three, lambda c: F.struct(
            c["uniform"].alias("uniform"), c["runs"].alias("runs"), c["serial"].alias("serial"),
            _bind(-(F.log(c["uniform"]) + F.log(c["runs"]) + F.log(c["serial"])), lambda half: F.exp(-half) * (1 + half + half * half / 2)).alias("all"),
        ))

    coded = _bind(alphabet, lambda a: F.struct(
        F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.position(c, a) - 1).cast("double")).alias("codes"),
        F.char_length(a).cast("double").alias("k")))
    return _bind(coded, with_codes)


def candidates(text: Column) -> Column:
    """All long tokens with an encoding: start, end, group (encoding and class of length), bin of the combined chance."""
    length = lambda v: sum((F.when(F.char_length(v) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0)).cast("string")
    named = F.transform(located(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), encoding(m["value"]).alias("encoding")))
    # A bin stands for its largest chance.
    bin_of = lambda c: F.least(F.floor(-F.log(F.greatest(c, F.lit(1e-300))) / BIN_WIDTH), F.lit(BINS)).cast("int")
    return F.transform(F.filter(named, lambda m: m["encoding"].isNotNull()), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.concat(m["encoding"], F.lit("-"), length(m["value"])).alias("group"),
        bin_of(chances(m["encoding"], m["value"])["all"]).alias("bin")))


def limits(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Per group the lowest bin that is found not to be random; at most BINS counts per group come back."""
    tested = docs.select(F.explode(F.transform(candidates(F.col(text)), lambda c: F.struct(c["group"].alias("group"), c["bin"].alias("bin")))).alias("c"))
    counts: dict[str, dict[int, int]] = {}
    for row in tested.groupBy("c.group", "c.bin").count().collect():
        counts.setdefault(row["group"], {})[row["bin"]] = row["count"]
    return {group: found for group, bins in counts.items() if (found := lowest_bin(bins)) is not None}


def lowest_bin(bins: dict[int, int]) -> int | None:
    """Benjamini and Hochberg's rule over counts per bin: the largest chance whose discoveries keep to the share."""
    total, so_far, out = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        so_far += bins[b]
        if math.exp(-b * BIN_WIDTH) <= FALSE_DISCOVERY * so_far / total:
            out = b
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    value = F.coalesce(F.col(text), F.lit(""))
    discovered = limits(docs, text)
    passes = lambda c: F.coalesce(*[F.when(c["group"] == g, c["bin"] < b) for g, b in sorted(discovered.items())], F.lit(True))
    found = docs.withColumns({
        "_assign": F.filter(located(value, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 8),
        "_access": located(value, ACCESS), "_hex": located(value, HEX), "_random": F.filter(candidates(value), passes),
    })
    base = F.concat(_spans(F.col("_assign"), "assign"), _spans(F.col("_access"), "access"), _spans(F.col("_hex"), "hex"))
    return found.withColumns({
        **{f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS},
        "base_sha256": F.sha2(_joined(base), 256), "spans": _joined(F.concat(base, _spans(F.col("_random"), "random"))),
    }).drop("_assign", "_access", "_hex", "_random")
