"""Property tests: Spark operators against plain-Python statements of the semantics."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterframe.operators import aggregates as agg
from meterframe.operators.filters import FilterParams

D = dt.date
LOCS = ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K"]
SCHEMA = "key bigint, meterid bigint, chargedate date, loc string, kwh double"

rows_st = st.lists(
    st.tuples(
        st.integers(0, 30),
        st.dates(D(2020, 1, 1), D(2020, 3, 31)),
        st.one_of(st.none(), st.sampled_from(LOCS)),
        st.one_of(st.none(), st.integers(0, 100).map(float)),
    ),
    min_size=0,
    max_size=40,
)
SETTINGS = settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


def _frame(spark, rows):
    return spark.createDataFrame([(i, m, d, loc, v) for i, (m, d, loc, v) in enumerate(rows)], SCHEMA)


@SETTINGS
@given(
    rows=rows_st,
    start=st.one_of(st.none(), st.dates(D(2020, 1, 1), D(2020, 3, 31))),
    end=st.one_of(st.none(), st.dates(D(2020, 1, 1), D(2020, 3, 31))),
    locs=st.lists(st.one_of(st.sampled_from(LOCS), st.just(""), st.none()), max_size=3),
    meters=st.lists(st.sampled_from(["1", "01", "7", "x", "30"]), max_size=3),
)
def test_filter_params_match_python(spark, rows, start, end, locs, meters):
    sel = {"loc": locs, "meterid": meters}
    got = sorted(r[0] for r in FilterParams(start, end, sel).apply(_frame(spark, rows)).select("key").collect())

    loc_vals = [str(v) for v in locs if v not in (None, "")]
    meter_vals = [str(v) for v in meters if v not in (None, "")]

    def keep(m, d, loc):
        if start is not None and d < start:
            return False
        if end is not None and d > end:
            return False
        if loc_vals and (loc is None or str(loc) not in loc_vals):
            return False
        if meter_vals and str(m) not in meter_vals:
            return False
        return True

    want = sorted(i for i, (m, d, loc, v) in enumerate(rows) if keep(m, d, loc))
    assert got == want


@SETTINGS
@given(rows=rows_st)
def test_composition_matches_python(spark, rows):
    got = [tuple(r) for r in agg.composition(_frame(spark, rows), FilterParams(metric="kwh"), segment="loc").orderBy("position").collect()]
    sums = {}
    for m, d, loc, v in rows:
        if loc is not None and v is not None:
            sums[loc] = sums.get(loc, 0.0) + v
    ordered = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))
    want = [(i, k, v) for i, (k, v) in enumerate(ordered[:8])]
    if len(ordered) > 8:
        want.append((8, "Other", sum(v for _, v in ordered[8:])))
    assert got == want


@SETTINGS
@given(rows=rows_st, freq=st.sampled_from(["D", "W", "M", "x"]))
def test_bucketed_mean_matches_python(spark, rows, freq):
    out = agg.bucketed_mean(_frame(spark, rows), FilterParams(freq=freq, metric="kwh")).collect()
    got = {r["bucket"]: r["kwh"] for r in out}

    def bucket(d):
        if freq == "W":
            return d - dt.timedelta(days=d.weekday())
        if freq == "M":
            return d.replace(day=1)
        return d

    groups = {}
    for m, d, loc, v in rows:
        groups.setdefault(bucket(d), []).append(v)
    want = {}
    for b, vs in groups.items():
        vals = [v for v in vs if v is not None]
        want[b] = sum(vals) / len(vals) if vals else 0.0
    assert got.keys() == want.keys()
    for b in want:
        assert abs(got[b] - want[b]) <= 1e-9 * max(1.0, abs(want[b]))


@SETTINGS
@given(rows=rows_st, cap=st.integers(1, 6))
def test_facets_match_python(spark, rows, cap):
    from meterframe.operators import facets as fc

    out = fc.facet_values(_frame(spark, rows), facets=["loc", "meterid"], caps={"meterid": cap}).collect()
    got = {}
    for r in out:
        got.setdefault(r["facet"], []).append((r["position"], r["value"]))
    locs = sorted({loc for _, _, loc, _ in rows if loc is not None})
    meters = sorted({str(m) for m, _, _, _ in rows})[:cap]
    assert sorted(got.get("loc", [])) == list(enumerate(locs))
    assert sorted(got.get("meterid", [])) == list(enumerate(meters))


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 40).map(float)), min_size=1, max_size=120),
    pcts=st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.64, 0.9, 1.0]), min_size=1, max_size=3, unique=True),
    few=st.booleans(),
)
def test_exact_percentiles_match_numpy_property(spark, values, pcts, few):
    import numpy as np

    from meterframe.functions.quantiles import exact_percentiles

    df = spark.createDataFrame(values, "g bigint, v double")
    out = exact_percentiles(df, "v", pcts, by=["g"], few_groups=few).collect()
    got = {(r["g"], r["percentage"]): r["v"] for r in out}
    want = {}
    for g in {g for g, _ in values}:
        arr = np.array([v for gg, v in values if gg == g])
        for p in pcts:
            want[(g, p)] = float(np.quantile(arr, p))
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) <= 1e-9 * max(1.0, abs(want[k]))


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(
    meters=st.lists(
        st.lists(st.tuples(st.integers(0, 15), st.one_of(st.none(), st.integers(0, 9).map(float))), min_size=1, max_size=25),
        min_size=1, max_size=4,
    ),
    parts=st.integers(1, 6),
    block=st.integers(1, 9),
    threshold=st.integers(0, 12),
)
def test_hot_path_matches_window_path_property(spark, meters, parts, block, threshold):
    import pandas as pd

    from meterframe.operators import features as ft

    data, key = [], 0
    for m, series in enumerate(meters):
        for day, v in series:
            data.append((key, m, D(2020, 1, 1) + dt.timedelta(days=day), "L", "R", v, None if v is None else v * 2, 1.0))
            key += 1
    df = spark.createDataFrame(data, "key bigint, meterid bigint, chargedate date, loc string, res string, "
                                     "kwh double, ghc double, paymoney double")
    old = (ft.RANGE_PARTITIONS, ft.BLOCK_ROWS)
    ft.RANGE_PARTITIONS, ft.BLOCK_ROWS = parts, block
    try:
        a = ft.build_features(df, with_targets=True, drop_incomplete=False, hot_key_rows=None).toPandas()
        b = ft.build_features(df, with_targets=True, drop_incomplete=False, hot_key_rows=threshold).toPandas()
    finally:
        ft.RANGE_PARTITIONS, ft.BLOCK_ROWS = old
    a = a.sort_values("key").reset_index(drop=True)
    b = b.sort_values("key").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
