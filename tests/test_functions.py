import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import rows
from meterframe.functions import dates, scalars

D = dt.date


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(0.0, 5.0, float("nan"), "x", 3), (2.0, 5.0, 1.0, "7.5", 12)], "a double, b double, c double, t string, m int")
    out = rows(df.select(
        scalars.safe_ratio("b", "a"), scalars.nan_to_null("c"), scalars.to_double("t"), scalars.zero_if_null(F.lit(None).cast("double")),
        scalars.month_sin(F.col("m")), scalars.month_cos(F.col("m")), scalars.thousands(F.lit(1234567.891)), scalars.lower_text(F.lit("AbC")),
    ))
    assert out[0][:4] == (None, None, None, 0.0)  # zero denominator, NaN and bad text -> null, not an error
    assert out[1][:3] == (2.5, 1.0, 7.5)
    assert math.isclose(out[0][4], 1.0) and abs(out[0][5]) < 1e-12  # month 3: sin(pi/2), cos(pi/2)
    assert math.isclose(out[1][4], 0.0, abs_tol=1e-12) and math.isclose(out[1][5], 1.0)
    assert out[0][6] == "1,234,567.89" and out[0][7] == "abc"


def test_date_helpers(spark):
    df = spark.createDataFrame([(D(2020, 3, 1),), (None,)], "d date")
    out = rows(df.select(
        dates.bucket(F.col("d"), "M"), dates.bucket_label(dates.bucket(F.col("d"), "M"), "M"),
        dates.bucket_label(dates.bucket(F.col("d"), "W"), "W"), dates.iso_text(F.col("d")),
        dates.weekday_name(F.col("d")), dates.month_short_name(F.col("d")), dates.is_weekend(F.col("d")),
        dates.month_end(F.col("d")), dates.weekday_index(F.col("d")),
    ))
    assert out[0] == (D(2020, 3, 1), "2020-03", "2020-02-24", "2020-03-01", "Sunday", "Mar", True, D(2020, 3, 31), 6)
    assert out[1][3] == ""  # missing date -> empty text, like the dashboard
    assert dates.trunc_unit("w") == "week" and dates.trunc_unit("nope") == "day"


def test_normalise_date_types(spark):
    df = spark.createDataFrame([("05-Jan-20", dt.datetime(2020, 1, 5, 13, 0))], "s string, ts timestamp")
    assert rows(dates.normalise_date(df, "s").select("s")) == [(D(2020, 1, 5),)]
    assert rows(dates.normalise_date(df, "ts").select("ts")) == [(D(2020, 1, 5),)]
    assert dates.normalise_date(df, "missing") is df
