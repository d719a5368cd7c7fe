"""Scalar helpers (I3, I7-I9, I11, I13) kept as native Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Spark treats NaN as a value (max/sum/median return NaN); the source does not."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c) -> Column:
    """Coerce to double, bad text -> null (ANSI-safe), NaN -> null."""
    return nan_to_null(col_(c).try_cast("double"))


def safe_ratio(num, den) -> Column:
    """I8: num / den with a zero denominator giving null instead of an ANSI error."""
    return F.try_divide(col_(num), col_(den))


def zero_if_null(c) -> Column:
    """I9."""
    return F.coalesce(col_(c), F.lit(0.0))


def month_sin(month: Column) -> Column:
    """sin(2*pi*month/12)."""
    return F.sin(F.lit(2 * math.pi) * month / F.lit(12.0))


def month_cos(month: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * month / F.lit(12.0))


def thousands(c, decimals: int = 2) -> Column:
    """I11: '1,234.57' style number text."""
    return F.format_number(col_(c), decimals)


def lower_text(c) -> Column:
    """I13."""
    return F.lower(col_(c))
