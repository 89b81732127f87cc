"""Search predicates to combine with ``&``, ``|`` and ``~``, and the two result orders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.periods import parse_iso
from postlake.functions.text import Col, WORD_CHARS, _col, fold_ascii, hashtags, like_any_case, mentions
from postlake.operators.store import page


def _fold(term: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), term)


def _quoted(term: str) -> str:
    """The term as a pattern both Java and RE2 take literally."""
    return re.sub(r"([^\w\s])", r"\\\1", _fold(term), flags=re.UNICODE)


def word(term: str, text: Col = "text") -> Column:
    """The term stands in the text as a whole word; false for a null text."""
    edge = f"[^{WORD_CHARS}]"
    return F.coalesce(fold_ascii(text).rlike(f"(?:^|{edge}){_quoted(term)}(?:{edge}|$)"), F.lit(False))


def keywords(*terms: str, text: Col = "text") -> Column:
    return reduce(lambda a, b: a & b, [word(t, text) for t in terms])


def any_of(*terms: str, text: Col = "text") -> Column:
    return reduce(lambda a, b: a | b, [word(t, text) for t in terms])


def exclude(term: str, text: Col = "text") -> Column:
    return ~word(term, text)


def phrase(words: str, text: Col = "text") -> Column:
    return F.contains(fold_ascii(text), F.lit(_fold(words)))


def from_user(name: str, username: Col = "username") -> Column:
    return fold_ascii(username) == _fold(name)


def mentions_user(name: str, text: Col = "text") -> Column:
    return F.array_contains(F.transform(mentions(text), fold_ascii), _fold("@" + name))


def has_hashtag(tag: str, text: Col = "text") -> Column:
    return F.array_contains(F.transform(hashtags(text), fold_ascii), _fold("#" + tag))


def since(day: str, created_at: Col = "created_at") -> Column:
    return parse_iso(created_at) >= F.lit(day).cast("timestamp")


def until(day: str, created_at: Col = "created_at") -> Column:
    """Up to but not including the day."""
    return parse_iso(created_at) < F.lit(day).cast("timestamp")


def language(code: str, lang: Col = "lang") -> Column:
    return _col(lang) == code


def search_text(posts: DataFrame, term: str, limit: int | None = 100) -> DataFrame:
    """Newest posts whose stored or original text contains the term."""
    hit = like_any_case("text", term) | like_any_case("original_text", term)
    return newest(posts.filter(hit), limit)


def newest(posts: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """By stored date text, newest first, nulls last, id to break ties."""
    return page(posts, F.col("created_at").desc_nulls_last(), F.col("id").asc(), limit=limit, offset=offset)


def top(posts: DataFrame, limit: int) -> DataFrame:
    """Most engaging first."""
    counters = ("retweet_count", "favorite_count", "reply_count", "quote_count")
    engagement = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in counters])
    return posts.withColumn("engagement", engagement).orderBy(F.desc("engagement"), F.asc("id")).limit(limit)


def results(posts: DataFrame, product: str, count: int) -> DataFrame:
    """``Latest`` or ``Top``, with a hard target of at least one row."""
    wanted = max(count, 1)
    if product == "Latest":
        return newest(posts, wanted)
    if product == "Top":
        return top(posts, wanted)
    raise ValueError(f"unknown product: {product}")
