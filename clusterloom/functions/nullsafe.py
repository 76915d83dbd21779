"""Cleaning of numbers and flags before they meet an aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators nearer to zero than this have no quotient.
EPS = 1e-12


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities: Spark averages skip NULL, not NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def number(text: Column | str) -> Column:
    """Text as a number, NULL where it is none (FLT-06)."""
    c = F.col(text) if isinstance(text, str) else text
    return finite(c.try_cast("double"))


def truthy(text: Column | str) -> Column:
    """'true' or '1' in any case, blanks around (FLT-05)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clean_target(c: Column) -> Column:
    """Non-finite to 0, then clipped to [0, 1] (FLT-08)."""
    return clip01(F.coalesce(finite(c), F.lit(0.0)))


def clean_utility(c: Column) -> Column:
    """NaN, NULL and -inf to 0, +inf to 1, clipped to [0, 1] (FLT-09)."""
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(clip01(c))


def safe_div(num: Column, den: Column) -> Column:
    """NULL for a missing, non-finite or near-zero denominator (FN-01)."""
    return F.when(F.abs(finite(den)) >= EPS, finite(num) / den)


def strip_prefix(c: Column, prefix: str = "utility__") -> Column:
    """Name without the prefix (FLT-11)."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
