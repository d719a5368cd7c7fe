"""Date helpers: parsing raw text dates, bucketing and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.schema import RAW_DATE_FORMATS

# Two-digit years: Spark maps 'yy' onto 2000-2099; the source system (C strptime
# / pandas) maps 69-99 onto 1969-1999.  Years at or above this one move back 100.
TWO_DIGIT_YEAR_PIVOT = 2069


def _has_two_digit_year(fmt: str) -> bool:
    return "yy" in fmt and "yyy" not in fmt


def parse_date(c: Column | str, formats=RAW_DATE_FORMATS) -> Column:
    """Text -> DATE trying each format in order; unparseable text -> null."""
    c = F.col(c) if isinstance(c, str) else c
    parsed = []
    for fmt in formats:
        d = F.to_date(F.try_to_timestamp(c, F.lit(fmt)))
        if _has_two_digit_year(fmt):
            d = F.when(F.year(d) >= TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)
        parsed.append(d)
    return F.coalesce(*parsed) if len(parsed) > 1 else parsed[0]


def normalise_date(df, name: str, formats=RAW_DATE_FORMATS):
    """Make ``name`` a DATE column; text is parsed, timestamps truncated."""
    if name not in df.columns:
        return df
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return df
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(name, F.to_date(F.col(name)))
    return df.withColumn(name, parse_date(F.col(name).cast("string"), formats))


def trunc_unit(freq: str | None) -> str:
    """UI frequency -> truncation unit; unknown means day."""
    return {"D": "day", "W": "week", "M": "month"}.get((freq or "D").upper(), "day")


def bucket(d: Column | str, freq: str | None) -> Column:
    """DATE bucket start: the day itself, Monday of the week, or first of month."""
    d = F.col(d) if isinstance(d, str) else d
    unit = trunc_unit(freq)
    if unit == "day":
        return F.to_date(d)
    return F.trunc(d, unit)  # trunc keeps DATE (date_trunc would give TIMESTAMP)


def bucket_label(b: Column, freq: str | None) -> Column:
    """I4: 'yyyy-MM' for months, ISO date otherwise."""
    if trunc_unit(freq) == "month":
        return F.date_format(b, "yyyy-MM")
    return b.cast("string")


def iso_text(d: Column) -> Column:
    """ISO date text ('' stays for missing, like the dashboard)."""
    return F.coalesce(F.to_date(d).cast("string"), F.lit(""))


def month_end(d: Column) -> Column:
    return F.last_day(d)


def weekday_index(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(d)


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_short_name(d: Column) -> Column:
    return F.date_format(d, "MMM")


def is_weekend(d: Column) -> Column:
    """Saturday or Sunday."""
    return F.weekday(d) >= 5
