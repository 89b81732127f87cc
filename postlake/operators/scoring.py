"""Sentiment scoring as pure column expressions: no join, no window, no shuffle, no Python worker.

A text is split once; every token is looked up in a constant word table; the order-sensitive rules
(boosters, negations, ``but``) read neighbouring array positions. Because a score is a projection,
the same code runs on a batch table and on a stream. ``score_with_table`` is the other way, for a
lexicon too large to sit in a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from postlake.functions.marks import label_from_compound, label_from_polarity
from postlake.functions.text import Col, JAVA_SPACE, WHITE_SPACE, _col, clean_text, fold_ascii
from postlake.operators import lexicon as L
from postlake.operators.stored import KeyedTable
from postlake.session import scratch_path

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Fixed values of the valence rule.
STEP_BACK = (1.0, 0.95, 0.9)
NORM, BANG, MAX_BANGS, QUESTION, MANY_QUESTIONS = 15.0, 0.292, 4, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a lambda would recompute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A gap between tokens: white space with the punctuation after it, and any token that is all punctuation.
#: Every quantifier is possessive, so long runs neither backtrack nor recurse.
_PUNCT_CLASS = r"!-/:-@\[-`{-~"
GAP = f"(?U)[{JAVA_SPACE}]++(?:[{_PUNCT_CLASS}]*+[{JAVA_SPACE}]++)*+[{_PUNCT_CLASS}]*+"
_OUTER = ASCII_PUNCTUATION + WHITE_SPACE


def _body(text: Column) -> Column:
    return F.btrim(text, F.lit(_OUTER))


def _split(body: Column) -> Column:
    """Tokens of a trimmed text; only closing punctuation is still on them."""
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))


def _strip(token: Column) -> Column:
    return F.rtrim(token, F.lit(ASCII_PUNCTUATION))


def tokens(text: Col) -> Column:
    return F.transform(_split(_body(_col(text))), _strip)


def _is_upper(token: Column) -> Column:
    return token.rlike(r"\p{Lu}") & ~token.rlike(r"\p{Ll}")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def punctuation_emphasis(text: Col) -> Column:
    bangs, questions = _count(_col(text), "!"), _count(_col(text), "?")
    asked = F.when(questions < 2, 0.0).when(questions < 4, questions * F.lit(QUESTION)).otherwise(MANY_QUESTIONS)
    return F.least(bangs, F.lit(MAX_BANGS)) * F.lit(BANG) + asked


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _hits(folded: Column, find: Callable[[Column], Column]) -> Column:
    """The listed words of a text in order: array of (position, properties)."""
    cells = F.transform(folded, lambda t: find(_strip(t)))
    placed = F.transform(cells, lambda c, i: F.when(c.isNotNull(), F.struct(i.alias("i"), c.alias("c"))))
    return F.filter(placed, lambda h: h.isNotNull())


def _near(hits: Column, h: Column, here: Column, reach: int) -> Column:
    """The listed words up to ``reach`` tokens before this one."""
    start = F.greatest(h - reach, F.lit(0))
    return F.filter(F.slice(hits, start + 1, h - start), lambda o: here["i"] - o["i"] <= reach)


def _valence_at(hits: Column, raw: Column, mixed: Column, but_at: Column) -> Callable:
    weights = F.array(*[F.lit(w) for w in STEP_BACK])

    def value(hit: Column, h: Column) -> Column:
        near = _near(hits, h, hit, len(STEP_BACK))
        return F.when(hit["c"]["v"] != 0, bind(near, lambda others: with_near(hit, others)))

    def with_near(hit: Column, others: Column) -> Column:
        start, i = hit["c"]["v"], hit["i"]

        def boost(acc: Column, o: Column) -> Column:
            counts = o["c"]["v"].isNull() & o["c"]["b"].isNotNull()
            return F.when(counts, acc + o["c"]["b"] * F.get(weights, i - o["i"] - 1)).otherwise(acc)

        shouted = mixed & F.coalesce(_is_upper(F.get(raw, i)), F.lit(False))
        strength = F.when(shouted, F.lit(L.CAPS)).otherwise(F.lit(0.0))
        v = start + F.signum(start) * F.aggregate(others, strength, boost)
        negated = F.exists(others, lambda o: F.coalesce(o["c"]["neg"], F.lit(False)))
        v = v * F.when(negated, F.lit(L.NEGATE)).otherwise(F.lit(1.0))
        return v * (
            F.when(but_at.isNull() | (i == but_at), 1.0).when(i < but_at, BEFORE_BUT).otherwise(AFTER_BUT)
        )

    return value


def _summary(values: Column, n_tokens: Column, emphasis: Column) -> Column:
    plus = F.filter(values, lambda v: v > 0)
    minus = F.filter(values, lambda v: v < 0)
    return F.struct(
        _total(values).alias("sum"),
        (_total(plus) + F.size(plus)).alias("pos"),
        (F.size(minus) - _total(minus)).alias("neg"),
        (n_tokens - F.size(plus) - F.size(minus)).cast("double").alias("neu"),
        emphasis.alias("emphasis"),
    )


def _fixed(value: Column, digits: int) -> Column:
    """Round half up after snapping to 12 decimals, so that the order of a sum cannot move a tie."""
    return F.round(value.cast("decimal(20,12)"), digits).cast("double")


def _sign(value: Column) -> Column:
    """Sums that cancel count as zero whatever order they were added in."""
    return F.signum(F.round(value, 9))


def _finish(parts: Column) -> Column:
    s = parts["sum"] + parts["emphasis"] * _sign(parts["sum"])
    compound = _fixed(F.coalesce(s / F.sqrt(s * s + F.lit(NORM)), F.lit(0.0)), 4)
    lead = _sign(parts["pos"] - parts["neg"])
    pos = parts["pos"] + F.when(lead > 0, parts["emphasis"]).otherwise(F.lit(0.0))
    neg = parts["neg"] + F.when(lead < 0, parts["emphasis"]).otherwise(F.lit(0.0))
    whole = pos + neg + parts["neu"]

    def share(part: Column) -> Column:
        return _fixed(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 3)

    return F.struct(
        compound.alias("compound"),
        share(pos).alias("positive"),
        share(neg).alias("negative"),
        share(parts["neu"]).alias("neutral"),
    )


def valence(text: Col, lexicon: L.ValenceLexicon = L.ENGLISH) -> Column:
    """Struct (compound, positive, negative, neutral, label) of a text; zeros and neutral when blank."""
    find = L.lookup(lexicon)
    safe = F.coalesce(_col(text), F.lit(""))
    # The written case matters only for shouted words, and most texts have none.
    may_shout = r"\p{Lu}{2}" if lexicon.all_words_have_letter_pairs() else r"\p{Lu}"

    def with_body(body: Column) -> Column:
        return bind(_split(fold_ascii(body)), lambda folded: with_folded(body, folded))

    def with_folded(body: Column, folded: Column) -> Column:
        context = F.struct(
            _hits(folded, find).alias("hits"),
            F.size(folded).alias("n"),
            F.when(body.rlike(may_shout), _split(body)).alias("raw"),
        )
        return bind(context, with_context)

    def with_context(c: Column) -> Column:
        once = F.struct(
            F.coalesce(F.exists(c["raw"], lambda t: ~_is_upper(t)), F.lit(False)).alias("mixed"),
            F.get(F.filter(c["hits"], lambda h: h["c"]["but"]), F.lit(0))["i"].alias("but_at"),
        )
        return bind(once, lambda o: with_values(c, o))

    def with_values(c: Column, o: Column) -> Column:
        values = F.transform(c["hits"], _valence_at(c["hits"], c["raw"], o["mixed"], o["but_at"]))
        used = F.filter(values, lambda v: v.isNotNull())
        return bind(used, lambda vs: bind(_summary(vs, c["n"], punctuation_emphasis(safe)), _finish))

    return bind(bind(_body(safe), with_body), _labelled)


def _labelled(s: Column) -> Column:
    kept = [s[f].alias(f) for f in ("compound", "positive", "negative", "neutral")]
    return F.struct(*kept, label_from_compound(s["compound"]).alias("label"))


def polarity(text: Col, lexicon: L.PolarityLexicon = L.ENGLISH_POLARITY) -> Column:
    """Struct (polarity, subjectivity, label): mean over matched words."""
    find = L.lookup(lexicon)
    safe = F.coalesce(_col(text), F.lit(""))

    def clip(v: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), v))

    def word(hits: Column) -> Callable:
        def value(hit: Column, h: Column) -> Column:
            return F.when(hit["c"]["p"].isNotNull(), bind(_near(hits, h, hit, 2), lambda others: with_near(hit, others)))

        def with_near(hit: Column, others: Column) -> Column:
            cell = hit["c"]

            def modify(acc: Column, o: Column) -> Column:
                return F.when(hit["i"] - o["i"] == 1, F.coalesce(o["c"]["m"], F.lit(1.0))).otherwise(acc)

            scale = F.aggregate(others, F.lit(1.0), modify)
            negated = F.exists(others, lambda o: F.coalesce(o["c"]["neg"], F.lit(False)))
            p = clip(cell["p"] * scale, -1.0, 1.0) * F.when(negated, F.lit(-0.5)).otherwise(F.lit(1.0))
            return F.struct(p.alias("p"), clip(cell["s"] * scale, 0.0, 1.0).alias("s"))

        return value

    def mean(values: Column) -> Column:
        n = F.size(values)
        return F.struct(
            F.coalesce(F.try_divide(_total(F.transform(values, lambda v: v["p"])), n), F.lit(0.0)).alias("polarity"),
            F.coalesce(F.try_divide(_total(F.transform(values, lambda v: v["s"])), n), F.lit(0.0)).alias("subjectivity"),
        )

    def with_hits(hits: Column) -> Column:
        found = F.filter(F.transform(hits, word(hits)), lambda v: v.isNotNull())
        return bind(found, mean)

    rounded = bind(
        bind(_hits(_split(fold_ascii(_body(safe))), find), with_hits),
        lambda m: F.struct(_fixed(m["polarity"], 6).alias("polarity"), _fixed(m["subjectivity"], 6).alias("subjectivity")),
    )
    return bind(
        rounded,
        lambda m: F.struct(
            m["polarity"].alias("polarity"), m["subjectivity"].alias("subjectivity"),
            label_from_polarity(m["polarity"]).alias("label"),
        ),
    )


SCORE_FIELDS = {
    "vader": ("compound", "positive", "negative", "neutral", "label"),
    "textblob": ("polarity", "subjectivity", "label"),
}


def scorer(method: str, lexicon=None) -> Callable[[Col], Column]:
    """Pick the rule by name; an unknown name is an error."""
    if method == "vader":
        return lambda text: valence(text, lexicon or L.ENGLISH)
    if method == "textblob":
        return lambda text: polarity(text, lexicon or L.ENGLISH_POLARITY)
    raise ValueError(f"unknown scoring method: {method}")


def score(df: DataFrame, method: str = "vader", text: str = "text", lexicon=None, prefix: str = "sentiment_") -> DataFrame:
    """Every input row plus flat, prefixed score columns and the method."""
    scored = df.withColumn("_score", scorer(method, lexicon)(text))
    flat = {f"{prefix}{f}": F.col(f"_score.{f}") for f in SCORE_FIELDS[method]}
    return scored.withColumns({**flat, f"{prefix}method": F.lit(method)}).drop("_score")


def enrich(posts: DataFrame, method: str = "vader", lexicon=None, clean: bool = True) -> DataFrame:
    """Clean the text, keep the original, score, flatten and tag with the method."""
    if clean:
        posts = posts.withColumns({"original_text": F.col("text"), "text": clean_text("text")})
        posts = posts.withColumn("cleaned_text", (F.coalesce("original_text", F.lit("")) != "").cast("int"))
    return score(posts, method, lexicon=lexicon)


def score_distinct(posts: DataFrame, method: str = "vader", lexicon=None, text: str = "text", row_key: str = "id") -> DataFrame:
    """Score each distinct text once and give the result to all of its copies.

    Texts meet by digest. Copies collapse map-side, and the way back spreads the digests that hold
    many copies, so a text that fills a third of the table is neither one group nor one task.
    """
    from postlake.operators.joins import lookup_left_join

    keyed = posts.withColumn("_text_key", text_key(text))
    once = keyed.groupBy("_text_key").agg(F.any_value(text).alias("_text"))
    memo = score(once, method, "_text", lexicon).drop("_text")
    return lookup_left_join(keyed, memo, "_text_key", [row_key]).drop("_text_key")


class ScoreMemo:
    """Scores of texts that are kept between runs, by digest of the text.

    A run scores only texts that no run before it has scored, each once, and writes those as one small run of a stored
    table. Known texts are found by a join of digests: a table far larger than the posts is cut by the engine's runtime
    Bloom filter before it is shuffled. One memo belongs to one method and word list.
    """

    def __init__(self, spark: SparkSession, path: str, method: str = "vader", lexicon=None):
        self.method, self.lexicon = method, lexicon
        sample = score(spark.createDataFrame([], "_text string"), method, "_text", lexicon).drop("_text")
        schema = StructType([StructField("_text_key", StringType()), *sample.schema.fields, StructField("_seq", IntegerType())])
        self.table = KeyedTable(spark, path, schema, ["_text_key"], "_seq")

    def score(self, posts: DataFrame, text: str = "text", row_key: str = "id") -> DataFrame:
        """All rows of ``posts`` with their scores; the memo has grown by the texts that are new to it."""
        from postlake.operators.joins import lookup_left_join

        keyed = posts.withColumn("_text_key", text_key(text))
        known = self.table.read().select("_text_key")
        once = keyed.groupBy("_text_key").agg(F.any_value(text).alias("_text")).join(known, "_text_key", "left_anti")
        fresh = score(once, self.method, "_text", self.lexicon).drop("_text").withColumn("_seq", F.lit(0))
        self.table.write(fresh, skip_empty=True)
        return lookup_left_join(keyed, self.table.read().drop("_seq"), "_text_key", [row_key]).drop("_text_key")


def text_key(text: Col) -> Column:
    """Texts meet by digest; null is a text of its own."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("\u0000")).cast("binary"))


def score_with_table(df: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The valence rule against a lexicon table of any size (token, valence, step, negation).

    Only words found in the table leave the scan; they carry their true positions, so neighbours
    are compared by distance. All words of one text share a row's bound, hence the window is safe.
    The table is written first, so that its size is known when the join is planned: a short one is broadcast, and
    the texts are not dealt out by word, where each frequent word would fill one task.
    """
    path = scratch_path(df.sparkSession, "words")
    words.write.parquet(path)
    words = df.sparkSession.read.parquet(path)
    safe = F.coalesce(F.col(text), F.lit(""))
    cased = df.select(key, tokens(safe).alias("_raw"), punctuation_emphasis(safe).alias("_emphasis"))
    per_text = cased.withColumns(
        {
            "_shout": F.exists("_raw", lambda t: ~_is_upper(t)),
            "_but": F.array_position(F.transform("_raw", fold_ascii), "but"),
        }
    )
    # The outer form: for the plain one the optimizer tests the size of the array below any shuffle of the texts, so that
    # they would be split once more where few tasks read them. Words that are null find no partner.
    exploded = per_text.select(key, "_shout", "_but", F.posexplode_outer("_raw").alias("_i", "_token"))
    matched = exploded.join(words, fold_ascii("_token") == F.col("token"), "inner")
    by_text = Window.partitionBy(key).orderBy("_i")
    before = by_text.rowsBetween(-3, -1)
    near = F.collect_list(F.struct("_i", "valence", "step", "negation")).over(before)
    sign = F.signum("valence")
    v = F.col("valence") + F.when(F.col("_shout") & _is_upper(F.col("_token")), F.lit(L.CAPS)).otherwise(0.0) * sign
    # Farthest neighbours come first in the list; the inline rule adds the nearest first.
    boosts = F.aggregate(
        F.reverse("_near"), F.lit(0.0),
        lambda acc, n: acc + F.when(
            n["valence"].isNull() & n["step"].isNotNull() & (F.col("_i") - n["_i"] <= 3),
            n["step"] * F.element_at(F.array(*[F.lit(w) for w in STEP_BACK]), F.least(F.col("_i") - n["_i"], F.lit(3))),
        ).otherwise(0.0),
    )
    negated = F.exists("_near", lambda n: F.coalesce(n["negation"], F.lit(False)) & (F.col("_i") - n["_i"] <= 3))
    v = v + boosts * sign
    v = F.when(negated, v * F.lit(L.NEGATE)).otherwise(v)
    at = F.col("_i") + 1
    v = F.when(F.col("_but") == 0, v).when(at < F.col("_but"), v * BEFORE_BUT).when(at > F.col("_but"), v * AFTER_BUT).otherwise(v)
    valued = matched.withColumn("_near", near).filter(F.col("valence").isNotNull() & (F.col("valence") != 0))
    sums = valued.withColumn("_v", v).groupBy(key).agg(
        F.sum("_v").alias("_s"),
        F.sum(F.when(F.col("_v") > 0, F.col("_v") + 1)).alias("_p"),
        F.sum(F.when(F.col("_v") < 0, 1 - F.col("_v"))).alias("_n"),
        F.count(F.when(F.col("_v") != 0, 1)).alias("_used"),
    )
    zero = F.lit(0.0)
    parts = F.struct(
        F.coalesce("_s", zero).alias("sum"), F.coalesce("_p", zero).alias("pos"), F.coalesce("_n", zero).alias("neg"),
        (F.col("_tokens") - F.coalesce("_used", F.lit(0))).cast("double").alias("neu"),
        F.col("_emphasis").alias("emphasis"),
    )
    sizes = cased.select(key, F.size("_raw").alias("_tokens"), "_emphasis")
    scored = sizes.join(sums, key, "left").withColumn("_score", _finish(parts))
    return scored.select(
        key, *[F.col(f"_score.{f}") for f in ("compound", "positive", "negative", "neutral")],
    ).withColumn("label", label_from_compound("compound"))
