"""Feature and forecast queries (K1, K2, F1-F7, F11, H8, H9, E34, E36, E37; K3-K9 rows-only)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from meterframe.operators import features as ft
from meterframe.operators import forecast as fc
from meterframe.plans.registry import register
from meterframe.plans.sql import with_sales
from meterframe.sources.adapters import sales_table as sales

D = dt.date
AS_OF = D(2000, 9, 30)
TRAIN_END, VALID_START, VALID_END = D(2000, 1, 1), D(2000, 1, 1), D(2000, 9, 30)
M3 = ft.METRIC_COLS
INT_FEATURES = {"month_num", "year", "loc_enc", "res_enc"}
LONG_FEATURES = {"kwh_count", "ghc_count", "paymoney_count"}
DOUBLE_FEATURES = [c for c in ft.FEATURES if c not in INT_FEATURES | LONG_FEATURES]


def _feature_ctes(as_of: str, targets: bool) -> str:
    lags = ", ".join(f"LAG({m}, {k}) OVER w AS {m}_lag{k}" for k in (1, 2, 3) for m in M3)
    rolls = []
    for m in M3:
        for name, (size, min_n) in ft.ROLLS.items():
            win = f"w{size}"
            rolls.append(f"CASE WHEN COUNT({m}) OVER {win} >= {min_n} THEN AVG({m}) OVER {win} END AS {m}_{name}_mean")
            rolls.append(f"CASE WHEN COUNT({m}) OVER {win} >= {min_n} THEN stddev_samp({m}) OVER {win} END AS {m}_{name}_std")
    leads = ", " + ", ".join(f"LEAD({m}, 1) OVER w AS {m}_next" for m in M3) if targets else ""
    prof = ", ".join(
        f"AVG({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, COUNT({m}) AS {m}_count" for m in M3
    )
    two_pi = repr(2 * math.pi)
    return (
        f"base AS (SELECT meterid, chargedate, key, loc, res, kwh, ghc, paymoney FROM sales "
        f"WHERE chargedate <= DATE '{as_of}' AND meterid IS NOT NULL), "
        "cl AS (SELECT loc, CAST(ROW_NUMBER() OVER (ORDER BY loc) - 1 AS INTEGER) AS loc_enc FROM (SELECT DISTINCT loc FROM base WHERE loc IS NOT NULL) AS t), "
        "cr AS (SELECT res, CAST(ROW_NUMBER() OVER (ORDER BY res) - 1 AS INTEGER) AS res_enc FROM (SELECT DISTINCT res FROM base WHERE res IS NOT NULL) AS t), "
        f"prof AS (SELECT meterid, {prof} FROM base GROUP BY meterid), "
        "wf AS (SELECT b.meterid, b.chargedate, b.key, b.loc, b.res, b.kwh, b.ghc, b.paymoney, "
        "CAST(month(b.chargedate) AS INTEGER) AS month_num, CAST(year(b.chargedate) AS INTEGER) AS year, "
        f"sin({two_pi} * CAST(month(b.chargedate) AS INTEGER) / 12.0) AS month_sin, "
        f"cos({two_pi} * CAST(month(b.chargedate) AS INTEGER) / 12.0) AS month_cos, "
        "COALESCE(cl.loc_enc, -1) AS loc_enc, COALESCE(cr.res_enc, -1) AS res_enc, "
        + ", ".join(f"p.{m}_mean, p.{m}_std, p.{m}_count" for m in M3) + ", "
        f"{lags}, {', '.join(rolls)}{leads} "
        "FROM base AS b LEFT JOIN cl ON b.loc = cl.loc LEFT JOIN cr ON b.res = cr.res "
        "LEFT JOIN prof AS p ON b.meterid = p.meterid "
        "WINDOW w AS (PARTITION BY b.meterid ORDER BY b.chargedate, b.key), "
        "w3 AS (PARTITION BY b.meterid ORDER BY b.chargedate, b.key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), "
        "w6 AS (PARTITION BY b.meterid ORDER BY b.chargedate, b.key ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), "
        "feat AS (SELECT *, "
        + ", ".join(f"{m} - {m}_lag1 AS {m}_delta1, {m}_lag1 - {m}_lag2 AS {m}_delta2" for m in M3)
        + ", ghc / NULLIF(kwh, 0) AS ghc_per_kwh, paymoney / NULLIF(ghc, 0) AS paymoney_ratio FROM wf "
        "WHERE kwh_lag3 IS NOT NULL AND ghc_lag3 IS NOT NULL AND paymoney_lag3 IS NOT NULL)"
    )


_FEATURE_SELECT = "SELECT meterid, chargedate, key, loc, res, " + ", ".join(ft.FEATURES)
_K01_SQL = with_sales(_FEATURE_SELECT + " FROM feat", _feature_ctes(AS_OF.isoformat(), False))


@register("k01_features", _K01_SQL, doubles=DOUBLE_FEATURES, dates=["chargedate"])
def q_k01(spark, sf):
    """The 47 model features per row, history cut at the as-of date, lag-3 rows only."""
    return ft.build_features(sales(spark, sf), AS_OF)


@register("k01_features_skew_path", _K01_SQL, doubles=DOUBLE_FEATURES, dates=["chargedate"])
def q_k01s(spark, sf):
    """The same features with a low hot-meter threshold: meters with more than ten
    rows take the positional path, the rest the window path, results unioned."""
    return ft.build_features(sales(spark, sf), AS_OF, hot_key_rows=10)


@register(
    "k02_training_frame",
    with_sales(
        _FEATURE_SELECT + ", kwh_next, ghc_next, paymoney_next FROM feat "
        "WHERE kwh_next IS NOT NULL AND ghc_next IS NOT NULL AND paymoney_next IS NOT NULL",
        _feature_ctes(AS_OF.isoformat(), True),
    ),
    doubles=DOUBLE_FEATURES + list(ft.TARGETS), dates=["chargedate"],
)
def q_k02(spark, sf):
    """Features plus next-period targets (rows without a next period dropped)."""
    return ft.training_frame(sales(spark, sf), AS_OF)


@register(
    "f07_latest_per_meter",
    with_sales(
        "SELECT meterid, chargedate AS as_of_month, key, kwh, kwh_lag1, kwh_roll3_mean FROM feat "
        "QUALIFY ROW_NUMBER() OVER (PARTITION BY meterid ORDER BY chargedate DESC, key ASC) = 1",
        _feature_ctes(AS_OF.isoformat(), False),
    ),
    doubles=["kwh", "kwh_lag1", "kwh_roll3_mean"], dates=["as_of_month"],
)
def q_f07(spark, sf):
    """Latest feature row per meter (the scoring rows), date renamed to as_of_month."""
    last = ft.latest_per_meter(ft.build_features(sales(spark, sf), AS_OF))
    return last.select("meterid", F.col("chargedate").alias("as_of_month"), "key", "kwh", "kwh_lag1", "kwh_roll3_mean")


@register(
    "h08_category_codes",
    with_sales("SELECT DISTINCT loc, loc_enc FROM feat", _feature_ctes(AS_OF.isoformat(), False)),
)
def q_h08(spark, sf):
    """Distinct (location, code) pairs of the feature table."""
    return ft.category_code_pairs(ft.build_features(sales(spark, sf), AS_OF), "loc")


@register(
    "h09_temporal_split",
    with_sales(
        "SELECT split, COUNT(*) AS \"rows\", COUNT(DISTINCT meterid) AS meters FROM ("
        "SELECT meterid, CASE WHEN chargedate < DATE '2000-01-01' THEN 'train' "
        "WHEN chargedate BETWEEN DATE '2000-01-01' AND DATE '2000-09-30' THEN 'valid' END AS split FROM feat "
        "WHERE kwh_next IS NOT NULL AND ghc_next IS NOT NULL AND paymoney_next IS NOT NULL) AS t "
        "WHERE split IS NOT NULL GROUP BY split",
        _feature_ctes(AS_OF.isoformat(), True),
    ),
)
def q_h09(spark, sf):
    """Rows and meters of the temporal train / validation split."""
    tf = fc.label_split(ft.training_frame(sales(spark, sf), AS_OF), TRAIN_END, VALID_START, VALID_END)
    return tf.filter(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("meterid").alias("meters")
    )


# Persistence baseline (next value = current value): deterministic predictions
# that let the evaluation operators be checked against SQL.
_BASELINE_CTE = _feature_ctes(AS_OF.isoformat(), True) + (
    ", pred AS (SELECT meterid, chargedate, loc, kwh_next, ghc_next, paymoney_next, "
    "kwh AS kwh_next_pred, ghc AS ghc_next_pred, paymoney AS paymoney_next_pred FROM feat "
    "WHERE kwh_next IS NOT NULL AND ghc_next IS NOT NULL AND paymoney_next IS NOT NULL "
    "AND chargedate BETWEEN DATE '2000-01-01' AND DATE '2000-09-30')"
)


def _baseline(spark, sf):
    tf = ft.training_frame(sales(spark, sf), AS_OF)
    _, valid = fc.temporal_split(tf, TRAIN_END, VALID_START, VALID_END)
    return valid.select(
        "meterid", "chargedate", "loc", *ft.TARGETS, *[F.col(m).alias(f"{m}_next_pred") for m in M3]
    )


@register(
    "e34_regression_metrics",
    with_sales(
        " UNION ALL ".join(
            f"SELECT '{t}' AS target, COUNT(*) AS n, AVG(abs({t}_pred - {t})) AS mae, "
            f"sqrt(AVG(({t}_pred - {t}) * ({t}_pred - {t}))) AS rmse, "
            f"1.0 - AVG(({t}_pred - {t}) * ({t}_pred - {t})) / NULLIF(var_pop({t}), 0) AS r2 "
            f"FROM pred WHERE {t} IS NOT NULL AND {t}_pred IS NOT NULL"
            for t in ft.TARGETS
        ),
        _BASELINE_CTE,
    ),
    doubles=["mae", "rmse", "r2"],
)
def q_e34(spark, sf):
    """MAE / RMSE / R^2 per target on the validation months (persistence predictions)."""
    return fc.all_metrics(_baseline(spark, sf), {t: f"{t}_pred" for t in ft.TARGETS})


_PRED_COLS = [f"{t}_pred" for t in ft.TARGETS] + list(ft.TARGETS)


@register(
    "e36_mean_by_month_location",
    with_sales(
        "SELECT CAST(date_trunc('month', chargedate) AS DATE) AS month, loc, "
        + ", ".join(f"AVG({c}) AS {c}" for c in _PRED_COLS) + " FROM pred GROUP BY 1, 2",
        _BASELINE_CTE,
    ),
    doubles=_PRED_COLS, dates=["month"],
)
def q_e36(spark, sf):
    """Mean predicted and true values per (month, location)."""
    return fc.mean_by_month_location(_baseline(spark, sf), _PRED_COLS)


@register(
    "e37_mean_by_meter",
    with_sales("SELECT meterid, " + ", ".join(f"AVG({c}) AS {c}" for c in _PRED_COLS) + " FROM pred GROUP BY 1", _BASELINE_CTE),
    doubles=_PRED_COLS,
)
def q_e37(spark, sf):
    """Mean predicted and true values per meter."""
    return fc.mean_by_meter(_baseline(spark, sf), _PRED_COLS)


# ----------------------------------------------------------------- importance tables (checkable parts)
# A table in the shape of the models' importances, made from the data: mean metric per location and target.
_IMPORTANCE = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{m}_next' AS target, loc AS feature, AVG(kwh) * {k + 1} AS importance FROM sales WHERE loc IS NOT NULL GROUP BY loc" for k, m in enumerate(M3)
) + ")"


def _importance(spark, sf):
    per = sales(spark, sf).filter("loc is not null").groupBy(F.col("loc").alias("feature")).agg(F.avg("kwh").alias("v"))
    each = F.array(*[F.struct(F.lit(f"{m}_next").alias("target"), (F.col("v") * F.lit(k + 1)).alias("importance")) for k, m in enumerate(M3)])
    return per.select("feature", F.explode(each).alias("e")).select("e.target", "feature", "e.importance")


@register("e35_importance_mean", with_sales("SELECT feature, AVG(importance) AS importance FROM imp GROUP BY feature", _IMPORTANCE), doubles=["importance"])
def q_e35m(spark, sf):
    """Mean importance per feature across targets."""
    return fc.mean_importance(_importance(spark, sf))


@register(
    "f10_top_per_target",
    with_sales(
        "SELECT target, feature, importance, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rank FROM imp "
        "WINDOW w AS (PARTITION BY target ORDER BY importance DESC, feature) QUALIFY ROW_NUMBER() OVER w <= 10",
        _IMPORTANCE,
    ),
    doubles=["importance"],
)
def q_f10(spark, sf):
    """First ten features per target by importance."""
    return fc.top_per_target(_importance(spark, sf), 10)


@register("g07_importance_head", with_sales("SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 15", _IMPORTANCE), doubles=["importance"])
def q_g07(spark, sf):
    """First fifteen rows by importance."""
    return fc.head_sorted(_importance(spark, sf), 15)


@register(
    "h06_combined_split",
    with_sales(
        "SELECT meterid, chargedate, key, kwh_next FROM feat WHERE kwh_next IS NOT NULL AND ghc_next IS NOT NULL "
        "AND paymoney_next IS NOT NULL AND chargedate <= DATE '2000-09-30'",
        _feature_ctes(AS_OF.isoformat(), True),
    ),
    doubles=["kwh_next"], dates=["chargedate"],
)
def q_h06(spark, sf):
    """The refit's rows: training and validation parts joined by column name."""
    train, valid = fc.temporal_split(ft.training_frame(sales(spark, sf), AS_OF), TRAIN_END, VALID_START, VALID_END)
    return fc.combine(train, valid).select("meterid", "chargedate", "key", "kwh_next")


# ----------------------------------------------------------------- models (rows-only)
# Every query on the trained models shares one training run per session and version of the data.
_TRAINED: dict = {}
#: Two candidates of the grid's kind.  Their rounds are those of the source's grid, which early stopping ends.
CANDIDATES = tuple(fc.GBTParams(max_iter=fc.SOURCE_GRID_ROUNDS, max_depth=d, step_size=0.1) for d in (5, 3))
PATIENCE, FIRST = 10, 16


def trained(spark, sf):
    from meterframe.sources.adapters import SALES_INPUTS, files_version

    key = (spark.sparkContext.applicationId, files_version(spark, [f"{sf}/{t}.parquet" for t in SALES_INPUTS]))
    if key not in _TRAINED:
        forecaster, _ = fc.train_forecaster(
            sales(spark, sf), AS_OF, TRAIN_END, VALID_START, VALID_END, candidates=CANDIDATES, refit=True, patience=PATIENCE, first=FIRST
        )
        _TRAINED.clear()
        _TRAINED[key] = forecaster
    return _TRAINED[key]


@register("k05_tuning", None, bench=False)
def q_k05(spark, sf):
    """The source's grid for one target by successive halving, one row per candidate."""
    train, valid = fc.temporal_split(ft.training_frame(sales(spark, sf), AS_OF), TRAIN_END, VALID_START, VALID_END)
    return fc.tune(fc.assemble(train, valid, fits=fc.PARALLELISM), "kwh_next", fc.source_grid(), PATIENCE, FIRST)[1]


@register("k05_trials", None, bench=False)
def q_k05t(spark, sf):
    """The candidates tried for each target by the trained forecaster."""
    return trained(spark, sf).trials


@register("k08_predict_next_month", None, bench=False)
def q_k08(spark, sf):
    """Tune the three GBT models on the temporal split with early stopping, refit, score the latest row per meter."""
    return fc.predict_next_month(sales(spark, sf), trained(spark, sf), AS_OF)


@register(
    "k08_scored_meters",
    with_sales(
        "SELECT meterid, max(chargedate) AS as_of_month, TRUE AS scored FROM feat GROUP BY meterid",
        _feature_ctes(AS_OF.isoformat(), False),
    ),
    dates=["as_of_month"], bench=False,
)
def q_k08m(spark, sf):
    """Which meters get a prediction, as of when, one row each, with all three predictions there."""
    pred = fc.predict_next_month(sales(spark, sf), trained(spark, sf), AS_OF)
    there = F.lit(True)
    for t in ft.TARGETS:
        there = there & F.col(f"{t}_pred").isNotNull()
    return pred.select("meterid", "as_of_month", there.alias("scored"))


@register("e35_mean_importance", None, bench=False)
def q_e35(spark, sf):
    """Mean GBT feature importance across the three targets."""
    return fc.mean_importance(fc.importance_table(spark, trained(spark, sf).models))
