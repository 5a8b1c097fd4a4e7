"""Encoding and type expressions (ordinal maps, safe casts, safe lookups)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal_code(c, codes: dict[str, int]) -> Column:
    """Map text to its code; unmapped text and null -> 0 (tinyint)."""
    pairs = []
    for k, v in codes.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(c)), F.lit(0)).cast("tinyint")


def to_float32(c) -> Column:
    """Non-strict downcast: anything that is not a number becomes null."""
    return _c(c).try_cast("float")


def to_model_numeric(c) -> Column:
    return _c(c).try_cast("float")


def to_model_categorical(c) -> Column:
    return _c(c).cast("string")


def null_if_nan(c) -> Column:
    """NaN -> null, so comparisons behave like the Python rules (NaN > x is false)."""
    c = _c(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_value(c, default: float) -> Column:
    """Column value, or ``default`` when it is null or NaN."""
    return F.coalesce(null_if_nan(c), F.lit(float(default)))
