"""Timestamps as stored text, and the calendar shard a post belongs to."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions.text import Col, _col

#: Extended ISO form: a date, optionally a time, optionally an offset.
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)


def parse_iso(c: Col) -> Column:
    """Instant of an ISO text, null when it is not one (UTC when no offset is given)."""
    raw = _col(c)
    return F.when(raw.rlike(ISO_SHAPE), F.try_to_timestamp(raw))


def period_of(year: Column, month: Column, shards_per_year: int) -> Column:
    """Quarter, month or custom slot, as ``<year>_<period>``."""
    if shards_per_year == 4:
        return F.concat(year.cast("string"), F.lit("_Q"), (F.floor((month - 1) / 3) + 1).cast("string"))
    if shards_per_year == 12:
        return F.concat(year.cast("string"), F.lit("_"), F.lpad(month.cast("string"), 2, "0"))
    slot = F.floor((month - 1) * F.lit(shards_per_year) / 12) + 1
    return F.concat(year.cast("string"), F.lit("_S"), _two_digits(slot))


def _two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def md5_slot(c: Col, modulus: int) -> Column:
    """The whole 128-bit digest modulo ``modulus``, by 32-bit digits so that a long is enough."""
    if not 1 <= modulus <= 1 << 30:
        raise ValueError("modulus must be between 1 and 2**30")
    digest = F.md5(_col(c).cast("binary"))
    rest = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        digit = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        rest = (rest * F.lit(1 << 32) + digit) % F.lit(modulus)
    return rest


def fallback_key(post_id: Col, shards_per_year: int) -> Column:
    return F.concat(F.lit("fallback_S"), _two_digits(md5_slot(post_id, shards_per_year) + 1))


def shard_key(created_at: Col, post_id: Col, shards_per_year: int = 4) -> Column:
    """Shard by the wall-clock year and month in the text; hash of the id when it is no date."""
    raw = _col(created_at)
    year = F.try_to_number(F.substring(raw, 1, 4), F.lit("9999")).cast("int")
    month = F.try_to_number(F.substring(raw, 6, 2), F.lit("99")).cast("int")
    return F.when(parse_iso(raw).isNotNull(), period_of(year, month, shards_per_year)).otherwise(
        fallback_key(F.coalesce(_col(post_id), F.lit("0")), shards_per_year)
    )


def shards_in_range(start: Col, end: Col, shards_per_year: int = 4) -> Column:
    """Sorted array of every shard key a date range touches; empty when the range is."""
    first, last = F.trunc(_col(start).cast("date"), "MM"), _col(end).cast("date")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    keys = F.transform(months, lambda m: period_of(F.year(m), F.month(m), shards_per_year))
    empty = F.array().cast("array<string>")
    return F.when(_col(start).cast("date") > last, empty).otherwise(F.array_sort(F.array_distinct(keys)))


def shard_keys_between(start: str, end: str, shards_per_year: int = 4) -> Column:
    """The same for two literal dates."""
    return shards_in_range(F.lit(start), F.lit(end), shards_per_year)
