"""Small labels, bands, keys and expiry rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions.text import Col, _col

#: Seconds an entry lives when none is given, and the cap of the outer tier.
TTL_SEARCH, TTL_SCORE, TTL_USER, OUTER_TIER_CAP = 1800, 86400, 600, 3600

NEUTRAL_BAND = 0.05


def label_from_compound(c: Col) -> Column:
    v = _col(c)
    return (
        F.when(v >= NEUTRAL_BAND, "positive").when(v <= -NEUTRAL_BAND, "negative").otherwise("neutral")
    )


def label_from_polarity(c: Col) -> Column:
    v = _col(c)
    return F.when(v > 0, "positive").when(v < 0, "negative").otherwise("neutral")


def threshold_band(c: Col, degraded_over: float = 80.0, unhealthy_over: float = 90.0) -> Column:
    v = _col(c)
    return (
        F.when(v.isNull(), "unknown")
        .when(v > unhealthy_over, "unhealthy")
        .when(v > degraded_over, "degraded")
        .otherwise("healthy")
    )


def size_mb(c: Col) -> Column:
    return F.round(_col(c) / F.lit(1048576.0), 2)


def result_key(prefix: str, *parts: Col) -> Column:
    """Digest that identifies one stored result. Each part stands behind its length, so no two lists share a text; a null is a dash."""
    texts = [F.lit(prefix), *[_col(p).cast("string") for p in parts]]
    told = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat_ws(":", *told).cast("binary"))


def effective_ttl(ttl: Col, default: int, cap: int | None = None) -> Column:
    """Zero and null both mean the default."""
    seconds = F.coalesce(F.nullif(_col(ttl), F.lit(0)), F.lit(default))
    return seconds if cap is None else F.least(seconds, F.lit(cap))


def expires_at(created: Col, ttl: Col, default: int, cap: int | None = None) -> Column:
    return _col(created) + F.make_dt_interval(secs=effective_ttl(ttl, default, cap).cast("decimal(18,6)"))


def alive(now: Column, expiry: Col, inclusive: bool = True) -> Column:
    """Inner caches count an entry at its very expiry as alive, the first tier does not."""
    return now <= _col(expiry) if inclusive else now < _col(expiry)


def ratio(part: Column, whole: Column) -> Column:
    """Guarded share: 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
