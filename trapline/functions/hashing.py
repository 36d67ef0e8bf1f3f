"""Randomness as a pure function of (seed, key, ...): the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # 52 bits: exactly representable in a double


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(str(part))).cast("string")


def digest(*parts) -> Column:
    """md5 of the parts joined by `|`. Its leading hex digits are an order-preserving bucket."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def unit_draw(*parts) -> Column:
    """A uniform number strictly inside (0, 1)."""
    digits = F.conv(F.substring(digest(*parts), 1, DIGITS), 16, 10).cast("bigint")
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def index_draw(n: Column, *parts) -> Column:
    """A uniform integer in [0, n)."""
    return F.floor(unit_draw(*parts) * n).cast("bigint")
