import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from meterframe.functions.quantiles import exact_percentiles
from meterframe.operators import aggregates as agg
from meterframe.operators import profile as pr
from meterframe.operators.filters import FilterParams

D = dt.date


def _locs(spark, values):
    return spark.createDataFrame(
        [(i, D(2020, 1, 1), loc, float(v)) for i, (loc, v) in enumerate(values)],
        "key bigint, chargedate date, loc string, kwh double",
    )


def test_composition_other_appears_only_beyond_top8(spark):
    ten = _locs(spark, [(f"L{i}", 10 - i) for i in range(10)])
    out = rows(agg.composition(ten, FilterParams(metric="kwh"), segment="loc").orderBy("position"))
    assert [r[1] for r in out] == [f"L{i}" for i in range(8)] + ["Other"]
    assert out[-1][2] == 2.0 + 1.0
    eight = _locs(spark, [(f"L{i}", 10 - i) for i in range(8)])
    assert "Other" not in [r[1] for r in rows(agg.composition(eight, FilterParams(metric="kwh"), segment="loc"))]


def test_composition_ties_nulls_and_nan(spark):
    df = _locs(spark, [("b", 5), ("a", 5), ("c", 7), (None, 100), ("d", float("nan"))])
    out = rows(agg.composition(df, FilterParams(metric="kwh"), segment="loc").orderBy("position"))
    assert out == [(0, "c", 7.0), (1, "a", 5.0), (2, "b", 5.0)]  # null segment and NaN-only group dropped
    assert rows(agg.composition(df, FilterParams(metric="kwh,ghc"), segment="loc")) == []


def test_share_of_total(spark):
    df = _locs(spark, [("a", 1), ("b", 3)])
    out = dict((r[1], r[3]) for r in rows(agg.share_of_total(agg.composition(df, FilterParams(metric="kwh"), segment="loc"))))
    assert out == {"a": 25.0, "b": 75.0}
    zero = _locs(spark, [("a", 0), ("b", 0)])
    assert {r[3] for r in rows(agg.share_of_total(agg.composition(zero, FilterParams(metric="kwh"), segment="loc")))} == {0.0}


def test_metric_stats_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 4.0), (3.0, None)], "kwh double, ghc double")
    out = {r["metric"]: r for r in agg.metric_stats(df).collect()}
    assert set(out) == {"kwh", "ghc"}
    assert (out["kwh"]["sum"], out["kwh"]["max"], out["kwh"]["median"], out["kwh"]["n"]) == (4.0, 3.0, 2.0, 2)
    assert out["ghc"]["median"] == 3.0 and out["ghc"]["mean"] == 3.0


def test_bucketed_mean_fills_null_average_with_zero(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, 1), None, 1.0), (2, D(2020, 2, 3), 4.0, 2.0), (3, None, 9.0, 9.0)],
        "key bigint, chargedate date, kwh double, ghc double",
    )
    out = rows(agg.bucketed_mean(df, FilterParams(freq="M", metric="kwh,ghc")))
    assert out == [(D(2020, 1, 1), "2020-01", 0.0, 1.0), (D(2020, 2, 1), "2020-02", 4.0, 2.0)]
    assert agg.bucketed_mean(df, FilterParams(metric="nosuch")).count() == 0


def test_summary_and_bounds_empty(spark):
    df = spark.createDataFrame([], "key bigint, meterid bigint, chargedate date, loc string, kwh double")
    assert rows(agg.dataset_summary(df)) == [(0, 5, 0, 0, "", "")]
    assert rows(agg.date_bounds(df)) == [("", "")]


def test_gap_months_filled(spark):
    df = spark.createDataFrame(
        [(1, 1, D(2020, 1, 10), 5.0), (2, 2, D(2020, 1, 11), 1.0), (3, 1, D(2020, 3, 1), 2.0)],
        "key bigint, meterid bigint, chargedate date, kwh double",
    )
    assert rows(pr.monthly_total(df).orderBy("month_end")) == [
        (D(2020, 1, 31), 6.0), (D(2020, 2, 29), 0.0), (D(2020, 3, 31), 2.0)]
    m = rows(pr.monthly_distinct_meters(df).orderBy("month_end"))
    assert [r[1] for r in m] == [2, 0, 1]
    ch = pr.period_change(pr.monthly_distinct_meters(df), "unique_meters", "month_end")
    assert rows(pr.largest_drop(ch)) == [(D(2020, 2, 29), 0, -2.0)]


def test_weekday_profile_has_seven_rows(spark):
    df = spark.createDataFrame([(D(2020, 3, 2), 4.0), (D(2020, 3, 8), 6.0)], "chargedate date, kwh double")
    out = rows(pr.mean_by_weekday(df).orderBy("weekday_num"))
    assert [r[1] for r in out] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    assert out[0][2] == 4.0 and out[6][2] == 6.0 and out[3][2] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.gamma(2.0, 30.0, 3000), 2)
    df = spark.createDataFrame(pd.DataFrame({"kwh": x}))
    got = [r[0] for r in rows(pr.histogram(df, ["kwh"], 50).orderBy("bin"), "count")]
    assert got == list(np.histogram(x, bins=50)[0])
    same = spark.createDataFrame(pd.DataFrame({"kwh": [3.0] * 5}))
    got = [r[0] for r in rows(pr.histogram(same, ["kwh"], 50).orderBy("bin"), "count")]
    assert got == list(np.histogram(np.array([3.0] * 5), bins=50)[0])


@pytest.mark.parametrize("shape", ["gap", "heavy", "two"])
def test_density_error_bound_far_from_the_data(spark, shape):
    """Grid points many bandwidths from any value keep their relative accuracy, down to the smallest doubles."""
    rng = np.random.default_rng(8)
    x = {"gap": np.concatenate([rng.normal(0, 1, 3000), rng.normal(40, 0.5, 20)]), "heavy": rng.standard_cauchy(2000), "two": np.array([0.0, 1.0])}[shape]
    out = pr.density(spark.createDataFrame(pd.DataFrame({"v": x})).repartition(4), "v", gridsize=160).orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    z = (out["x"].to_numpy()[:, None] - x[None, :]) / bw
    want = np.exp(-0.5 * z * z).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    near = want > 1e-280
    np.testing.assert_allclose(out["density"][near], want[near], rtol=1e-10)
    assert (out["density"][~near] < 1e-279).all()


def test_density_makes_no_row_per_value(spark):
    plan = pr.density(spark.range(5000).selectExpr("rand(3) AS v"), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [cell")


def test_density_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 15, 500)
    out = pr.density(spark.createDataFrame(pd.DataFrame({"v": x})), "v", gridsize=50).orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(out["x"], grid, rtol=1e-9)
    np.testing.assert_allclose(out["density"], want, rtol=1e-9)


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"kwh": [1.0, 2.0, 4.0, 8.0, None], "loc": ["b", "a", "b", "a", "c"]})
    out = {r["column_name"]: r for r in pr.describe_all(spark.createDataFrame(pdf)).collect()}
    want = pdf.describe(include="all")
    assert out["kwh"]["q25"] == want.loc["25%", "kwh"] and out["kwh"]["q75"] == want.loc["75%", "kwh"]
    assert math.isclose(out["kwh"]["std"], want.loc["std", "kwh"])
    assert (out["loc"]["unique"], out["loc"]["freq"]) == (3, 2)
    assert out["loc"]["top"] == "a"  # tie between a and b: smallest value


def test_percentile_fixture(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "kwh double")
    assert rows(pr.percentile_under_filter(df, "kwh", 0.64)) == [(pytest.approx(2.56),)]


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    g = rng.integers(0, 3, 4000)
    v = np.concatenate([np.round(rng.lognormal(3, 1, 2000), 1), rng.normal(0, 1e-5, 1990), [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, 1.0, 1.0, 1.0, 1.0]])
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    ps = [0.0, 0.1, 0.25, 0.5, 0.64, 0.99, 1.0]
    for few in (False, True):
        out = exact_percentiles(df, "v", ps, by=["g"], few_groups=few).toPandas()
        for (grp, p), val in out.set_index(["g", "percentage"])["v"].items():
            assert val == pytest.approx(np.quantile(v[g == grp], p), rel=1e-12, abs=0)
        assert len(out) == 3 * len(ps)


@pytest.mark.parametrize("accuracy", [20, 200])
def test_exact_percentiles_inside_narrow_brackets(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {
        "spread": rng.normal(size=4001),
        "ties": rng.integers(0, 3, 3000).astype(float),
        "one": np.full(2500, 7.0),
        "tail": np.concatenate([rng.random(2000) * 1e-9, [1e300, -1e300]]),
        "signs": np.where(rng.random(1500) < 0.5, -0.0, 0.0),
        "few": rng.random(5),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    ps = [0.0, 0.001, 0.25, 0.5, 0.64, 0.999, 1.0]
    for few in (True, False):
        out = exact_percentiles(df, "v", ps, by=["g"], few_groups=few, accuracy=accuracy).collect()
        assert len(out) == len(ps) * len(groups)
        for r in out:
            assert r["v"] == pytest.approx(np.quantile(groups[r["g"]], r["percentage"]), rel=1e-12, abs=0.0), (r, few)


def test_exact_percentiles_read_the_input_twice(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS g", "rand(1) AS v").write.parquet(str(tmp_path / "t"))
    plan = exact_percentiles(spark.read.parquet(str(tmp_path / "t")), "v", [0.25, 0.5], by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange") <= 6


def test_exact_percentiles_null_groups_infinity_and_ties(spark):
    inf = float("inf")
    data = [(None, 1.0), (None, 3.0), ("a", inf), ("a", inf), ("a", 1.0), ("b", -inf), ("c", None), ("c", float("nan"))] + [("d", 7.0)] * 500
    df = spark.createDataFrame(data, "g string, v double")
    out = {(r["g"], r["percentage"]): r["v"] for r in exact_percentiles(df, "v", [0.5, 1.0], by=["g"]).collect()}
    assert out == {(None, 0.5): 2.0, (None, 1.0): 3.0, ("a", 0.5): inf, ("a", 1.0): inf, ("b", 0.5): -inf, ("b", 1.0): -inf, ("d", 0.5): 7.0, ("d", 1.0): 7.0}
    assert exact_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_exact_percentiles_many_groups_and_no_job_while_planning(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS g", "CAST(id AS DOUBLE) AS v")
    spark.sparkContext.setJobGroup("planning", "percentiles")
    out = exact_percentiles(df, "v", [0.5], by=["g"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("run", "percentiles")
    assert out.filter("v <> g + 20000").count() == 0 and out.count() == 20_000


def test_activity_summary_tie_break(spark):
    df = spark.createDataFrame([(5,), (5,), (3,), (3,), (9,)], "meterid bigint")
    assert rows(pr.activity_summary(df)) == [(3, 5 / 3, 2.0, 3, 2)]


def test_correlation_matches_pandas(spark):
    pdf = pd.DataFrame({"kwh": [1.0, 2.0, 3.0, 4.0, None], "ghc": [2.0, 4.1, 5.9, 8.2, 1.0], "paymoney": [1.0, 0.0, 1.0, 0.0, 3.0]})
    out = {(r[0], r[1]): r[2] for r in rows(pr.correlation_matrix(spark.createDataFrame(pdf)))}
    want = pdf.corr()
    for (a, b), v in out.items():
        assert v == pytest.approx(want.loc[a, b])


def test_dashboard_panels_match_pandas_semantics(spark, sf_small):
    """Pie, bar, stats and summary panels against an independent pandas computation."""
    from meterframe.sources.adapters import sales_table

    s = sales_table(spark, sf_small)
    p = FilterParams(start=D(1996, 1, 1), end=D(1999, 12, 31), selections={"res_mapped": ["Commercial", "Residential"]}, metric="ghc")
    pdf = s.toPandas()
    pdf["chargedate"] = pd.to_datetime(pdf["chargedate"])
    f = pdf[pdf["res_mapped"].astype(str).isin(["Commercial", "Residential"])]
    f = f[(f["chargedate"] >= pd.Timestamp(D(1996, 1, 1))) & (f["chargedate"] <= pd.Timestamp(D(1999, 12, 31)))]

    # pie: sum by loc, descending, top 8 + Other
    grp = f.dropna(subset=["loc"]).dropna(subset=["ghc"]).groupby(f["loc"].astype(str))["ghc"].sum().sort_values(ascending=False)
    want = list(grp.iloc[:8].items()) + [("Other", grp.iloc[8:].sum())]
    got = [(r[1], r[2]) for r in rows(agg.composition(s, p, segment="loc").orderBy("position"))]
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-12)

    # bar: all locations
    bar = dict((r[0], r[1]) for r in rows(agg.totals_by_location(s, p)))
    assert bar.keys() == grp.to_dict().keys()
    np.testing.assert_allclose([bar[k] for k in grp.index], grp.to_numpy(), rtol=1e-12)

    # stats panel
    stats = {r["metric"]: r for r in agg.metric_stats(p.apply(s)).collect()}
    for m in ("kwh", "ghc", "paymoney"):
        col = pd.to_numeric(f[m], errors="coerce").dropna()
        assert stats[m]["n"] == len(col)
        np.testing.assert_allclose(
            [stats[m][k] for k in ("sum", "mean", "median", "min", "max")],
            [col.sum(), col.mean(), col.median(), col.min(), col.max()], rtol=1e-12)

    # summary panel
    summ = rows(agg.dataset_summary(p.apply(s)))[0]
    assert summ == (len(f), len(s.columns), f["meterid"].nunique(), f["loc"].nunique(),
                    f["chargedate"].min().date().isoformat(), f["chargedate"].max().date().isoformat())


def test_endpoint_payloads(spark):
    from meterframe.plans import endpoints as ep

    df = spark.createDataFrame(
        [(1, 10, D(2020, 1, 5), "N1", "Commercial", 2.0), (2, 11, D(2020, 1, 9), "N2", "Residential", 4.0),
         (3, 10, D(2020, 2, 1), "N1", "Commercial", None)],
        "key bigint, meterid bigint, chargedate date, loc string, res_mapped string, kwh double",
    )
    assert ep.chart_data(df, {"freq": "M", "metric": "kwh,nosuch"}) == {
        "labels": ["2020-01", "2020-02"], "values": {"kwh": [3.0, 0.0]}, "metric_labels": {"kwh": "kWh"}, "date_col": "chargedate"}
    assert ep.pie_data(df, {"metric": "kwh"})["labels"] == ["Residential", "Commercial"]
    assert ep.bar_data(df, {"metric": "kwh", "LOC": ["N1"]}) == {"labels": ["N1"], "values": [2.0], "metric_label": "kWh", "segment": "loc"}
    opts = ep.filter_options(df, {"selections": {"loc": ["N1"]}})
    assert opts == {"options": {"loc": ["N1"], "meterid": ["10"], "res_mapped": ["Commercial"]}, "truncated": [],
                    "dates": {"min": "2020-01-05", "max": "2020-02-01"}, "rows": 2}
    assert ep.meter_options(df, {"q": "1", "limit": "1"}) == ["10"]
    assert ep.stats(df, {})["kwh"]["median"] == 3.0
    assert ep.summary(df, {"start_date": "2020-01-06"})["rows"] == 2
    assert ep.health(df) == {"status": "ok", "rows": 3, "cols": 6}


def test_describe_dates_matches_pandas(spark):
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 4), D(2020, 1, 10), None]
    pdf = pd.DataFrame({"d": pd.to_datetime(days)})
    want = pdf["d"].describe()
    got = rows(pr.describe_dates(spark.createDataFrame([(x,) for x in days], "d date")))[0]
    fmt = lambda t: pd.Timestamp(t).strftime("%Y-%m-%d %H:%M:%S")
    assert got == ("d", 4.0, fmt(want["mean"]), fmt(want["min"]), fmt(want["25%"]), fmt(want["50%"]), fmt(want["75%"]), fmt(want["max"]))
    assert got[2] == "2020-01-04 06:00:00"


def test_exploration_report_runs(spark, sf_small):
    from meterframe.sources.adapters import sales_table

    rep = pr.exploration_report(sales_table(spark, sf_small))
    assert len(rep) == 23
    sizes = {k: v.count() for k, v in rep.items()}
    assert sizes["by_weekday"] == 7 and sizes["largest_drop"] == 1 and sizes["usage_density"] == 200
    assert sizes["clean"] > 0 and sizes["sample"] == min(5000, sizes["clean"])


def test_approximate_options(spark):
    df = spark.createDataFrame([(float(i), i % 7, "L" + str(i % 3)) for i in range(1, 101)], "kwh double, meterid bigint, loc string")
    exact = rows(pr.percentile_under_filter(df, "kwh", 0.5))[0][0]
    approx = rows(pr.percentile_under_filter(df, "kwh", 0.5, exact=False))[0][0]
    assert exact == 50.5 and approx in (50.0, 51.0)  # approx returns a value of the column
    summary = rows(agg.dataset_summary(df, approximate=True), "meters", "locations")
    assert summary == [(7, 3)]
    med = {r["metric"]: r["median"] for r in agg.metric_stats(df, exact_median=False).collect()}
    assert med["kwh"] in (50.0, 51.0)


def test_describe_approximate_quartiles(spark):
    pdf = pd.DataFrame({"kwh": [float(i) for i in range(1, 102)]})
    df = spark.createDataFrame(pdf)
    exact = rows(pr.describe_all(df), "q25", "q50", "q75")[0]
    approx = rows(pr.describe_all(df, exact=False), "q25", "q50", "q75")[0]
    assert exact == (26.0, 51.0, 76.0)
    assert all(abs(a - e) <= 1.0 for a, e in zip(approx, exact))


def test_activity_summary_empty(spark):
    df = spark.createDataFrame([], "meterid bigint")
    assert rows(pr.activity_summary(df)) == [(0, None, None, None, None)]
