"""Stored summaries against the same operators over rows, on awkward rows and in appended parts."""

import datetime as dt
import random
import re

import pytest
from conftest import rows
from meterframe.operators import aggregates as agg, facets, profile as pr, summaries as sm
from meterframe.operators.filters import FilterParams

SCHEMA = "chargedate date, meterid long, loc string, res_mapped string, kwh double, ghc double, paymoney double, key long"
NAN = float("nan")


def _data(n=3000, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        day = None if r.random() < 0.03 else dt.date(2019, 11, 1) + dt.timedelta(r.randrange(260)) if r.random() < 0.9 else dt.date(2021, 3, 5)
        meter = r.choice([None, -1, -32768, 0, 1, 32768, 32769, 10**12, *range(100000, 100060)])
        values = [r.choice([None, NAN, 0.0, float(r.randrange(500)) / 4]) for _ in range(3)]
        out.append((day, meter, r.choice([None, "A", "B", "C"]), r.choice([None, "Commercial", "Residential"]), *values, k))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_data(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rolled(table):
    return sm.rollup(sm.roll_up(table).cache(), table)


def _same(a, b):
    assert a.columns == b.columns
    key = lambda r: [str(v) for v in r]
    got, want = sorted(rows(a), key=key), sorted(rows(b), key=key)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert [pytest.approx(v, rel=1e-12, nan_ok=True) if isinstance(v, float) else v for v in y] == list(x)


FILTERS = [
    FilterParams(freq="M", metric="kwh,ghc"),
    FilterParams(freq="W", metric="paymoney", selections={"loc": ["A", "B"]}),
    FilterParams(freq="D", metric="kwh", start=dt.date(2020, 1, 15), end=dt.date(2020, 3, 2), selections={"res_mapped": ["Commercial"], "nosuch": ["x"]}),
    FilterParams(freq="M", metric="kwh", selections={"meterid": ["100001"]}),
    FilterParams(freq="M", metric="kwh", selections={"loc": ["nowhere"]}),
    FilterParams(freq="M", metric="nosuch"),
    FilterParams(start=dt.date(2020, 1, 1), end=dt.date(2020, 2, 29), metric="ghc", selections={"loc": ["C"]}),
]


@pytest.mark.parametrize("i", range(len(FILTERS)))
def test_rollup_and_rows_agree(table, rolled, i):
    p = FILTERS[i]
    _same(sm.bucketed_mean(rolled, table, p), agg.bucketed_mean(table, p))
    _same(sm.split_series(rolled, table, p, "loc"), agg.split_series(table, p, "loc")) if "nosuch" != p.metric else None
    _same(sm.totals_by_location(rolled, table, p), agg.totals_by_location(table, p))
    bitmaps = sm.meter_bitmaps(table)
    _same(sm.dataset_summary(rolled, bitmaps, table, p), agg.dataset_summary(p.apply(table)))


def test_daily_series_with_nan_and_null(table, rolled):
    for loc, res in ((None, None), ("A", None), ("A", "Commercial")):
        args = (dt.date(2019, 12, 1), dt.date(2020, 4, 1), "kwh", loc, res)
        _same(sm.daily_series(rolled, table, *args), agg.daily_series(table, *args))


def test_which_route_is_taken(table, rolled):
    covered = [rolled.covers(p, table, ["kwh"]) for p in FILTERS[:5]]
    assert covered == [True, True, True, False, True]
    plan = sm.bucketed_mean(rolled, table, FILTERS[0])._jdf.queryExecution().analyzed().toString()
    assert "kwh_sum" in plan and sm.bucketed_mean(rolled, table, FILTERS[3])._jdf.queryExecution().analyzed().toString().count("kwh_sum") == 0
    assert not sm._whole_months(FilterParams(end=dt.date(2020, 2, 28))) and sm._whole_months(FilterParams(start=dt.date(2020, 2, 1), end=dt.date(2020, 2, 29)))


def test_a_new_month_is_appended(spark, tmp_path, table):
    old, new = table.filter("chargedate < '2020-05-01' or chargedate is null"), table.filter("chargedate >= '2020-05-01'")
    for part in (old, new):
        sm.roll_up(part).write.mode("append").parquet(str(tmp_path / "rollup"))
        sm.meter_bitmaps(part).write.mode("append").parquet(str(tmp_path / "bitmaps"))
    rolled = sm.rollup(spark.read.parquet(str(tmp_path / "rollup")), table)
    bitmaps = spark.read.parquet(str(tmp_path / "bitmaps"))
    _same(sm.bucketed_mean(rolled, table, FILTERS[0]), agg.bucketed_mean(table, FILTERS[0]))
    _same(sm.monthly_distinct_meters(bitmaps), pr.monthly_distinct_meters(table))
    _same(sm.dataset_summary(rolled, bitmaps, table), agg.dataset_summary(table))
    # Late rows of a month that is there already merge as well.
    sm.meter_bitmaps(new.limit(50)).write.mode("append").parquet(str(tmp_path / "bitmaps"))
    _same(sm.monthly_distinct_meters(spark.read.parquet(str(tmp_path / "bitmaps"))), pr.monthly_distinct_meters(table))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    r = sm.rollup(sm.roll_up(empty), empty)
    _same(sm.bucketed_mean(r, empty, FILTERS[0]), agg.bucketed_mean(empty, FILTERS[0]))
    _same(sm.dataset_summary(r, sm.meter_bitmaps(empty), empty), agg.dataset_summary(empty))
    assert sm.monthly_distinct_meters(sm.meter_bitmaps(empty)).count() == 0


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    r = random.Random(4)
    names = ["".join(r.choice("ABab12-é") for _ in range(r.randint(1, 9))) for _ in range(400)] + ["İab", "ab", "", None]
    df = spark.createDataFrame([(n, r.choice(["X", "Y", None])) for n in names for _ in range(2)], "meterid string, loc string").cache()
    return df, sm.write_meter_index(df, str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("q", ["", "a", "ab1", "AB-", "aab|12b", "ab.*12", "a+b1", "ab?1", "^ab", "12$", "(ab)1", "[ab]12", "a..b", "ab1*a", "ab\\d", "é1a", ".ab12", "ab++"])
def test_meter_search_narrowed_by_grams(named, q):
    df, index = named
    for p in (None, FilterParams(selections={"loc": ["X"], "meterid": ["ab"]})):
        for regex in (True, False):
            _same(sm.meter_options(index, df, p, q, regex=regex), facets.meter_options(df, p, q, regex=regex))
    for loc in (None, "Y") if "\\" not in q else ():  # a stray escape is an error in LIKE
        _same(sm.meter_options_by_location(index, loc, q), facets.meter_options_by_location(df, loc, q))


def test_like_wildcards_and_limits(named):
    df, index = named
    for q in ("a_1", "ab%12", "%", "ab1\\_", "b1_a"):
        _same(sm.meter_options_by_location(index, None, q, 5), facets.meter_options_by_location(df, None, q, limit=5))


def test_pieces_are_in_every_match():
    r = random.Random(9)
    for _ in range(3000):
        q = "".join(r.choice("aab1.*+?^$") for _ in range(r.randint(1, 7)))
        try:
            pattern = re.compile(q)
        except re.error:
            continue
        for _ in range(5):
            text = "".join(r.choice("ab1") for _ in range(r.randint(0, 8)))
            if pattern.search(text):
                assert all(p in text for p in sm.regex_pieces(q)), (q, text)


def test_sparse_meters_take_small_rows_in_hash_aggregates(spark):
    """Far apart ids, both ends of the range of longs among them: no wide bitmap row is built, sorted or stored."""
    ids = [None, -(2**63), -65, -64, -1, 0, 63, 64, 2**62, 2**63 - 1] + [k * 10**6 for k in range(1, 300)]
    data = [(dt.date(2020, 1 + k % 3, 1), m, "A", "Commercial", 1.0, 1.0, 1.0, i) for i, (m, k) in enumerate((m, k) for m in ids for k in (0, 1, 1))]
    df = spark.createDataFrame(data, SCHEMA)
    bitmaps = sm.meter_bitmaps(df)
    _same(sm.monthly_distinct_meters(bitmaps), pr.monthly_distinct_meters(df))
    _same(sm.dataset_summary(sm.rollup(sm.roll_up(df), df), bitmaps, df), agg.dataset_summary(df))
    assert dict(bitmaps.dtypes)["bits"] == "bigint"
    for made in (bitmaps, sm.monthly_distinct_meters(bitmaps)):
        assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
