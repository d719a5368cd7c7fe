"""Cleaning and projection.

All functions are DataFrame -> DataFrame and usable with ``df.transform``.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.functions.dates import is_weekend, normalise_date
from meterframe.functions.scalars import nan_to_null
from meterframe.schema import DEFAULT_ROLES, RAW_DATE_FORMATS, RES_DISPLAY, UNKNOWN_LABEL, Roles


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """B1: drop rows equal in every column (one shuffle on the full row)."""
    return df.dropDuplicates()


def drop_any_null(df: DataFrame) -> DataFrame:
    """B2: drop rows with a null (or NaN) in any column."""
    return df.dropna(how="any")


def drop_null_in(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows with a null in the named columns that exist."""
    cols = [c for c in columns if c in df.columns]
    return df.dropna(subset=cols) if cols else df


def recode_residence(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """``res`` -> ``res_mapped`` through the fixed map; anything else 'Unknown'."""
    if roles.residence not in df.columns or not roles.res_map:
        return df
    mapping = F.create_map(*[F.lit(x) for kv in roles.res_map.items() for x in kv])
    return df.withColumn(
        roles.residence_mapped,
        F.coalesce(mapping[F.col(roles.residence).cast("string")], F.lit(UNKNOWN_LABEL)),
    )


def coerce_metrics(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Metric columns to double; unparseable text and NaN become null."""
    for m in roles.present_metrics(df.columns):
        df = df.withColumn(m, nan_to_null(F.col(m).try_cast("double")))
    return df


def parse_dates(df: DataFrame, roles: Roles = DEFAULT_ROLES, formats=RAW_DATE_FORMATS) -> DataFrame:
    """Date column to DATE; skipped when it already is one."""
    return normalise_date(df, roles.date, formats)


def preprocess(df: DataFrame, roles: Roles = DEFAULT_ROLES, formats=RAW_DATE_FORMATS) -> DataFrame:
    """Dedupe -> drop rows with any null -> recode -> parse dates -> coerce metrics.

    The order is the source's: coercion failures after the null drop are kept
    as nulls.
    """
    return (
        df.transform(drop_exact_duplicates)
        .transform(drop_any_null)
        .transform(lambda d: recode_residence(d, roles))
        .transform(lambda d: parse_dates(d, roles, formats))
        .transform(lambda d: coerce_metrics(d, roles))
    )


def date_first(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Date column cast to DATE and moved first, the rest unchanged."""
    if roles.date not in df.columns:
        return df
    others = [F.col(c) for c in df.columns if c != roles.date]
    return df.select(F.to_date(F.col(roles.date)).alias(roles.date), *others)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop named columns; missing names are ignored."""
    return df.drop(*list(names))


def project(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the listed columns (those present), in the listed order."""
    return df.select(*[c for c in names if c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B10."""
    for a, b in mapping.items():
        df = df.withColumnRenamed(a, b)
    return df


def validity_filter(df: DataFrame) -> DataFrame:
    """Kwh > 0, ghc >= 0, paymoney >= 0 (null fails, as in the source)."""
    return df.filter((F.col("kwh") > 0) & (F.col("ghc") >= 0) & (F.col("paymoney") >= 0))


def eda_clean(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Exploration cleaning: dedupe, validity filter, drop null keys, drop text copies."""
    out = drop_exact_duplicates(df).transform(validity_filter)
    out = drop_null_in(out, [roles.date, roles.location, roles.residence])
    return drop_columns(out, ["chargedate_str", "month_str", "month"])


def add_weekend_flag(df: DataFrame, roles: Roles = DEFAULT_ROLES, name: str = "is_weekend") -> DataFrame:
    """B12."""
    return df.withColumn(name, is_weekend(F.col(roles.date)))


def residence_display(c) -> F.Column:
    """Residence code -> display label (unmapped -> null)."""
    mapping = F.create_map(*[F.lit(x) for kv in RES_DISPLAY.items() for x in kv])
    return mapping[c]


def day_type(flag) -> F.Column:
    """Weekend flag -> 'Weekend' / 'Weekday'."""
    return F.when(flag, F.lit("Weekend")).when(~flag, F.lit("Weekday"))
