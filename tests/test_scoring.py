import math
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import lexicon as L, scoring as N


def scores(spark, texts, method="vader", lexicon=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = N.score(rows, method, lexicon=lexicon, prefix="").orderBy("id").collect()
    return [r.asDict() for r in out]


def test_sentences(spark):
    love, hate, okay = scores(
        spark, ["I love this product! It's amazing!", "I hate this terrible product!", "The product is okay."]
    )
    assert love["label"] == "positive" and love["compound"] > 0.05
    assert hate["label"] == "negative" and hate["compound"] < -0.05
    assert okay["label"] == "neutral" and abs(okay["compound"]) < 0.05
    love, hate = scores(spark, ["I love this product! It's amazing!", "I hate this terrible product!"], "textblob")
    assert love["polarity"] > 0 and hate["polarity"] < 0


def test_blank(spark):
    for method, field in (("vader", "compound"), ("textblob", "polarity")):
        for r in scores(spark, ["", None, "   ", "!!! ---"], method):
            assert r["label"] == "neutral" and r[field] == 0.0


def test_unknown_method():
    with pytest.raises(ValueError):
        N.scorer("magic")


def _tokens(text):
    return [t for t in (w.strip(N.ASCII_PUNCTUATION) for w in text.split()) if t]


def _fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(text, lex):
    """The rule, one token after the other."""
    toks = _tokens(text)
    low = [_fold(t) for t in toks]
    upper = lambda t: any(c.isupper() for c in t) and not any(c.islower() for c in t)
    mixed = any(not upper(t) for t in toks)
    but = low.index("but") if "but" in low else None
    values = []
    for i, w in enumerate(low):
        v = lex.valences.get(w)
        if not v:
            continue
        sign = math.copysign(1, v)
        if mixed and upper(toks[i]):
            v += 0.733 * sign
        negated = False
        for d, k in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i - d < 0:
                break
            o = low[i - d]
            if o not in lex.valences and o in lex.boosters:
                v += lex.boosters[o] * sign * k
            negated |= o in lex.negations
        if negated:
            v *= -0.74
        if but is not None and i != but:
            v *= 0.5 if i < but else 1.5
        values.append(v)
    s = sum(values)
    q = text.count("?")
    e = 0.292 * min(text.count("!"), 4) + (0 if q < 2 else 0.18 * q if q < 4 else 0.96)
    pos, neg = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    neu = len(toks) - sum(v != 0 for v in values)
    sign, lead = round(s, 9), round(pos - neg, 9)
    s += e * (sign > 0) - e * (sign < 0)
    if lead > 0:
        pos += e
    elif lead < 0:
        neg += e
    whole = pos + neg + neu
    share = lambda x: x / whole if whole else 0.0
    return s / math.sqrt(s * s + 15), share(pos), share(neg), share(neu)


def _random_texts(n, seed=5):
    rnd = random.Random(seed)
    words = [*L.ENGLISH.valences, *L.ENGLISH.boosters, *L.ENGLISH.negations, "but", "table", "É", "x1", "--", "..."]
    ends = ["", "", "", "!", "?", "??", ",", "...", ")"]
    out = []
    for _ in range(n):
        toks = []
        for _ in range(rnd.randrange(0, 14)):
            w = rnd.choice(words)
            w = rnd.choice([w, w, w.upper(), w.title(), "(" + w])
            toks.append(w + rnd.choice(ends))
        out.append(rnd.choice([" ", "  ", "\n", " "]).join(toks))
    return out


def test_against_brute_force(spark):
    texts = _random_texts(400) + ["GREAT", "GREAT BAD", "not GREAT but very bad", ". " * 20000 + "good", "-" * 50000 + " bad"]
    for text, got in zip(texts, scores(spark, texts)):
        compound, pos, neg, neu = brute(text, L.ENGLISH)
        have = (got["compound"], got["positive"], got["negative"], got["neutral"])
        assert have == pytest.approx((compound, pos, neg, neu), abs=6e-4), text


def test_table_equals_inline(spark):
    texts = _random_texts(300, seed=9)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = {**{w: (v, None, None) for w, v in L.ENGLISH.valences.items()}}
    for w, b in L.ENGLISH.boosters.items():
        words[w] = (None, b, None)
    for w in L.ENGLISH.negations:
        words[w] = (*words.get(w, (None, None))[:2], True)
    table = spark.createDataFrame([(w, *p) for w, p in words.items()], "token string, valence double, step double, negation boolean")
    by_table = {r["id"]: r for r in N.score_with_table(rows, table, "id").collect()}
    for i, inline in enumerate(scores(spark, texts)):
        other = by_table[i]
        assert other["label"] == inline["label"]
        for f in ("compound", "positive", "negative", "neutral"):
            assert other[f] == pytest.approx(inline[f], abs=2e-4), texts[i]
    assert L.from_table(table).entries() == L.ENGLISH.entries()


def test_large_lexicon_is_grouped(spark):
    lex = L.ValenceLexicon({f"w{i}x": float(i % 7 - 3) for i in range(30_000)}, {}, ())
    texts = ["w1x w2x w2999x", "w6x nothing"]
    for text, got in zip(texts, scores(spark, texts, lexicon=lex)):
        assert got["compound"] == pytest.approx(brute(text, lex)[0], abs=1e-4)


def test_polarity_rule(spark):
    a, b, c = scores(spark, ["very good", "not good", "good bad unknown"], "textblob")
    assert a["polarity"] == pytest.approx(0.91) and b["polarity"] == pytest.approx(-0.35)
    assert c["polarity"] == pytest.approx(0.0) and c["subjectivity"] == pytest.approx(0.635)


def test_copies_share_one_score(spark):
    rows = spark.createDataFrame([(i, "great!" if i % 3 else f"bad {i}") for i in range(300)], "id int, text string")
    memo = {r["id"]: r["sentiment_compound"] for r in N.score_distinct(rows).collect()}
    direct = {r["id"]: r["sentiment_compound"] for r in N.score(rows).collect()}
    assert memo == direct and len(memo) == 300


def test_enrich_keeps_every_row(spark):
    rows = spark.createDataFrame([("1", "great http://x"), ("2", None), ("3", "")], "id string, text string")
    got = {r["id"]: r for r in N.enrich(rows).collect()}
    assert got["1"]["text"] == "great" and got["1"]["original_text"] == "great http://x" and got["1"]["cleaned_text"] == 1
    assert got["2"]["sentiment_label"] == "neutral" and got["3"]["cleaned_text"] == 0
    assert rows.count() == len(got)


def test_scoring_needs_no_shuffle(spark):
    plan = N.enrich(spark.range(5).select(F.col("id").cast("string"), F.lit("x").alias("text")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_stored_memo(spark, monkeypatch):
    """A second run over the same texts scores nothing; new texts, null and copies are scored once."""
    from postlake.session import scratch_path
    from postlake.sources import versions

    texts = ["love it", "bad, bad", None, "", "table", "love it"] * 5
    first = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    more = first.unionByName(spark.createDataFrame([("x", "a great day"), ("y", "love it")], first.schema))
    memo = N.ScoreMemo(spark, scratch_path(spark, "t-memo"))
    want = lambda df: sorted(((r["id"], r["sentiment_compound"], r["sentiment_label"]) for r in N.score(df).collect()))
    got = lambda df: sorted(((r["id"], r["sentiment_compound"], r["sentiment_label"]) for r in df.collect()))
    assert got(memo.score(first)) == want(first)
    assert memo.table.read().count() == 5 and versions.latest(spark, memo.table.path)["version"] == 1
    assert got(memo.score(first)) == want(first)
    assert versions.latest(spark, memo.table.path)["version"] == 1
    assert got(memo.score(more)) == want(more)
    assert memo.table.read().count() == 6 and versions.latest(spark, memo.table.path)["version"] == 2
