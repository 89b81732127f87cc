"""Text functions as native column expressions.

The classes below spell out Unicode word and white-space characters in a form that both Java
and RE2 read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE_CHARS}]+"
LINK_RUN = f"(?:http|www)[^{SPACE_CHARS}]+"

# The same sets in the spelling Java matches fastest: one predicate for the white-space property,
# a literal prefix for the common link.
JAVA_SPACE = r"\s\x1c-\x1f"
JAVA_SPACES = f"(?U)[{JAVA_SPACE}]+"
JAVA_LINK_RUN = f"(?U)(?:http|www)[^{JAVA_SPACE}]+"
JAVA_HTTP_RUN = f"(?U)http[^{JAVA_SPACE}]+"
HASHTAG = f"#[{WORD_CHARS}]+"
MENTION = f"@[{WORD_CHARS}]+"
URL = r"https?://[!$-_a-z]+"
NOT_ALNUM = r"[^\p{L}\p{N}]"

#: Every white-space character, for trimming.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

Col = Column | str


def _col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_ascii(c: Col) -> Column:
    """Lower-case A-Z only, the folding a stored LIKE applies. Pure ASCII text takes the fast way."""
    text = _col(c)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def clean_text(c: Col) -> Column:
    """Drop link runs, mentions and hashtags, then collapse white space."""
    text = _col(c)
    out = F.when(F.contains(text, F.lit("www")), F.regexp_replace(text, JAVA_LINK_RUN, "")).otherwise(
        F.regexp_replace(text, JAVA_HTTP_RUN, "")
    )
    for pattern in (MENTION, HASHTAG):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, JAVA_SPACES, " "))


def hashtags(c: Col) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(HASHTAG), 0)


def mentions(c: Col) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(MENTION), 0)


def urls(c: Col) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(URL), 0)


def metadata_entries(c: Col) -> Column:
    """Array of (metadata_type, value), one entry per match, repeats kept."""

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("metadata_type"), v.alias("value")))

    return F.concat(
        tagged("hashtag", hashtags(c)), tagged("mention", mentions(c)), tagged("url", urls(c))
    )


def safe_name(c: Col, max_length: int = 30) -> Column:
    return F.substring(F.regexp_replace(_col(c), NOT_ALNUM, "_"), 1, max_length)


def output_name(query: Col, at: Col, extension: str) -> Column:
    stamp = F.date_format(_col(at), "yyyyMMdd_HHmmss")
    return F.concat(F.lit("tweets_"), safe_name(query), F.lit("_"), stamp, F.lit(f".{extension}"))


def query_type(c: Col) -> Column:
    """Kind of an SQL statement by its first word."""
    head = F.upper(F.regexp_replace(_col(c), f"^{SPACES}", ""))
    out = None
    for kind in ("SELECT", "INSERT", "UPDATE", "DELETE"):
        cond = head.startswith(kind)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("OTHER")


#: Case-sensitive substrings and the label each one gives, first rule wins.
LABEL_RULES = (
    ("positive", ("love", "great", "excellent")),
    ("negative", ("terrible", "poor", "waste")),
)


def rule_label(c: Col) -> Column:
    out = None
    for label, words in LABEL_RULES:
        cond = None
        for w in words:
            hit = F.contains(_col(c), F.lit(w))
            cond = hit if cond is None else cond | hit
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("neutral")


def like_any_case(c: Col, term: str) -> Column:
    """Contains, ASCII case ignored; ``%`` and ``_`` of the term stay wildcards."""
    folded = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in term).replace("\\", "\\\\")
    return fold_ascii(c).like(f"%{folded}%")
