import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from meterframe.functions.dates import bucket, parse_date
from meterframe.operators import clean
from meterframe.sources.readers import run_query
from meterframe.operators.filters import (
    FilterParams, filter_by_request, like_search, params_from_request, regex_search, validate_metrics,
)

D = dt.date

RAW = [
    # chargedate, meterid, loc, res, kwh, ghc, paymoney
    ("05-Jan-20", 1, "A [1]", "N-Resid [0]", "10", "1.5", "1.0"),
    ("5-Jan-20", 2, "A [1]", "Resid [1]", "20", "2.5", "2.0"),
    ("05-jan-20", 3, "B [2]", "Resid [1]", "x", "3.5", "3.0"),
    ("31-Dec-69", 4, "B [2]", "Other", "40", "4.5", "4.0"),
    ("2020-01-05", 5, "B [2]", "Resid [1]", "50", "5.5", "5.0"),
    ("bad", 6, "B [2]", "Resid [1]", "60", "6.5", "6.0"),
    ("05-Jan-20", 1, "A [1]", "N-Resid [0]", "10", "1.5", "1.0"),  # exact duplicate
    ("06-Jan-20", 7, "A [1]", None, "70", "7.5", "7.0"),  # empty field -> dropped
]
RAW_SCHEMA = "chargedate string, meterid bigint, loc string, res string, kwh string, ghc string, paymoney string"


def test_preprocess_raw_csv(spark):
    df = clean.preprocess(spark.createDataFrame(RAW, RAW_SCHEMA))
    got = {r["meterid"]: r for r in df.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]  # duplicate and the row with an empty field removed
    assert got[1]["chargedate"] == D(2020, 1, 5)
    assert got[2]["chargedate"] == D(2020, 1, 5)  # one-digit day
    assert got[3]["chargedate"] == D(2020, 1, 5)  # lower-case month
    assert got[4]["chargedate"] == D(1969, 12, 31)  # two-digit year pivot like C strptime
    assert got[5]["chargedate"] is None  # ISO text is not the raw format
    assert got[6]["chargedate"] is None
    assert got[3]["kwh"] is None  # coercion failure kept as null
    assert got[1]["res_mapped"] == "Commercial" and got[2]["res_mapped"] == "Residential"
    assert got[4]["res_mapped"] == "Unknown"


def test_parse_date_more_formats(spark):
    df = spark.createDataFrame([("2020-01-05",), ("05-Jan-20",)], "d string")
    out = rows(df.select(parse_date(F.col("d"), ("d-MMM-yy", "yyyy-MM-dd"))))
    assert out == [(D(2020, 1, 5),), (D(2020, 1, 5),)]


def test_week_edges(spark):
    df = spark.createDataFrame([(D(2020, 3, 1),), (D(2019, 12, 31),), (D(2020, 1, 1),)], "d date")
    assert rows(df.select(bucket(F.col("d"), "W"))) == [(D(2020, 2, 24),), (D(2019, 12, 30),), (D(2019, 12, 30),)]
    assert rows(df.select(bucket(F.col("d"), "x"))) == [(D(2020, 3, 1),), (D(2019, 12, 31),), (D(2020, 1, 1),)]


def test_validity_filter_and_eda_clean(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 1.0, 1.0), (2, 5.0, -1.0, 1.0), (3, 5.0, 1.0, None), (4, 5.0, 0.0, 0.0)],
        "meterid bigint, kwh double, ghc double, paymoney double",
    )
    assert [r[0] for r in rows(clean.validity_filter(df), "meterid")] == [4]


SALES = [
    (1, 10, D(1996, 1, 5), "NATION_3", "Commercial", 1.0),
    (2, 11, D(1996, 6, 5), "NATION_7", "Residential", 2.0),
    (3, 12, D(1997, 1, 5), "NATION_3", "Commercial", 3.0),
    (4, 1, D(1996, 2, 5), "NATION_3", "Commercial", 4.0),
]
SALES_SCHEMA = "key bigint, meterid bigint, chargedate date, loc string, res_mapped string, kwh double"


def test_filter_params_and_range(spark):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    p = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), selections={"loc": ["NATION_3", "", None]})
    assert sorted(r[0] for r in rows(p.apply(df), "key")) == [1, 4]
    # Text selections on a bigint column: '01' can never equal the text of 1.
    p = FilterParams(selections={"meterid": ["1", "01", "x"]})
    assert [r[0] for r in rows(p.apply(df), "key")] == [4]
    assert rows(FilterParams(end=D(1996, 1, 5)).apply(df), "key") == [(1,)]  # end day inclusive
    assert FilterParams(selections={"nosuch": ["x"]}).apply(df).count() == 4


def test_request_parsing(spark):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    p = params_from_request({"LOC": ["NATION_3", "", None], "nosuch": ["x"], "freq": "x", "kwh": ["1"]}, df.columns)
    assert p.selections == {"loc": ["NATION_3"]} and p.freq == "D"
    p = params_from_request({"selections": {"Loc": ["NATION_7"], "meterid": "11"}, "start_date": "bad"}, df.columns)
    assert p.selections == {"loc": ["NATION_7"]} and p.start is None
    assert filter_by_request(df, {"LOC": ["NATION_7"]}).count() == 1


def test_metric_validation(spark):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    assert validate_metrics(df, "kwh,nosuch") == ["kwh"]
    assert validate_metrics(df, "kwh,ghc", multi=False) == []


def test_search_regex_like_literal(spark):
    df = spark.createDataFrame([("1",), ("10",), ("21",), ("110",), ("1.0",)], "v string")

    def hits(pred):
        return sorted(r[0] for r in rows(df.filter(pred), "v"))

    assert hits(regex_search(F.col("v"), "^1")) == ["1", "1.0", "10", "110"]
    assert hits(regex_search(F.col("v"), "1.0")) == ["1.0", "110"]  # '.' is any character
    assert hits(regex_search(F.col("v"), "1.0", literal=True)) == ["1.0"]
    assert hits(like_search(F.col("v"), "1_")) == ["1.0", "10", "110"]  # '_' one character
    assert hits(like_search(F.col("v"), "%1")) == ["1", "1.0", "10", "110", "21"]
    with pytest.raises(ValueError):
        regex_search(F.col("v"), "(")  # malformed pattern fails on the driver


def test_filter_pushed_to_scan(spark, sf_small):
    from meterframe.sources.adapters import sales_table

    df = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), selections={"loc": ["NATION_3"], "meterid": ["5"]}).apply(
        sales_table(spark, sf_small)
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    for frag in ("loc", "chargedate", "meterid"):
        assert frag in plan.split("PushedFilters")[1].split("]")[0]


def test_to_sql_where_matches_predicate(spark):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    df.createOrReplaceTempView("t_where")
    p = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), selections={"loc": ["NATION_3"], "nosuch": ["x"]})
    clause, params = p.to_sql_where("chargedate", df.columns)
    assert clause == "CAST(chargedate AS DATE) >= ? AND CAST(chargedate AS DATE) <= ? AND CAST(loc AS STRING) IN (?)"
    via_sql = sorted(r[0] for r in run_query(spark, f"SELECT key FROM t_where WHERE {clause}", params).collect())
    assert via_sql == sorted(r[0] for r in rows(p.apply(df), "key")) == [1, 4]
    assert FilterParams().to_sql_where() == ("1=1", [])


def test_selection_on_double_compares_text(spark):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    assert rows(FilterParams(selections={"kwh": ["2.0"]}).apply(df), "key") == [(2,)]
