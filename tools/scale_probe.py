"""Scale probe: time headline operators on a larger table derived from the given data.

usage: python tools/scale_probe.py [--sf DIR] [--copies N]

The billing table of ``--sf`` is replicated N times with shifted keys and meter
ids (N times the rows and meters) and written to the scratch folder.  A second,
skewed variant gives one meter a third of all rows.  The probe then times:
the bucketed mean, the composition, the facets, the metric stats (whose exact
medians take the narrowing path once a metric has more than 2M values), and
the feature build on the plain and on the skewed table (hot-meter path), and
checks that the hot-meter path and the window path agree on the skewed table
(largest relative difference per value, and rows null on one path only).
Prints one JSON line.  Not a registered query: a measurement tool.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=20)
    a = ap.parse_args()

    from pyspark.sql import functions as F

    from meterframe.operators import aggregates as agg
    from meterframe.operators import facets as fc
    from meterframe.operators import features as ft
    from meterframe.operators.filters import FilterParams
    from meterframe.session import build_session, scratch_path
    from meterframe.sources.adapters import sales_table

    spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": "32", "spark.driver.memory": "16g"})
    base = sales_table(spark, a.sf)
    # Replicate each row N times by exploding a generated sequence (no join).
    big = base.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.copies - 1).cast("long")))).select(
        (F.col("key") + F.col("_c") * F.lit(10**9)).alias("key"),
        (F.col("meterid") + F.col("_c") * F.lit(10**8)).alias("meterid"),
        "chargedate", "loc", "res", "kwh", "ghc", "paymoney", "res_mapped",
    )
    path = scratch_path(spark, "probe_big")
    big.write.parquet(path)
    big = spark.read.parquet(path)
    # Skewed variant: every third row belongs to one meter.
    skew_path = scratch_path(spark, "probe_skew")
    big.withColumn("meterid", F.when(F.col("key") % 3 == 0, F.lit(-1)).otherwise(F.col("meterid"))).write.parquet(skew_path)
    skew = spark.read.parquet(skew_path)
    n = big.count()

    def timed(name, build):
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return name, round(time.perf_counter() - t0, 2)

    as_of = dt.date(2000, 9, 30)
    hot_rows = max(n // 10, 1)
    results = dict(
        [
            timed("bucketed_mean", lambda: agg.bucketed_mean(big, FilterParams(freq="M", metric="kwh,ghc,paymoney"))),
            timed("composition", lambda: agg.composition(big, FilterParams(metric="ghc"), segment="loc")),
            timed("facets", lambda: fc.facet_values(big)),
            timed("metric_stats_exact_median", lambda: agg.metric_stats(big)),
            timed("features_window_path", lambda: ft.build_features(big, as_of)),
            timed("features_skewed_hot_path", lambda: ft.build_features(skew, as_of, hot_key_rows=hot_rows)),
        ]
    )
    w = ft.build_features(skew, as_of, hot_key_rows=None)
    h = ft.build_features(skew, as_of, hot_key_rows=hot_rows)
    feats = list(ft.FEATURES)
    j = w.select("key", *[F.col(c).cast("double").alias(f"w_{c}") for c in feats]).join(
        h.select("key", *[F.col(c).cast("double").alias(f"h_{c}") for c in feats]), "key", "full_outer")
    rel = [F.abs(F.col(f"w_{c}") - F.col(f"h_{c}")) / F.greatest(F.abs(F.col(f"w_{c}")), F.lit(1e-300)) for c in feats]
    nulls = [(F.col(f"w_{c}").isNull() != F.col(f"h_{c}").isNull()).cast("int") for c in feats]
    check = j.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.greatest(*rel)).alias("max_rel_diff"),
        F.sum(sum(nulls[1:], nulls[0])).alias("null_mismatches"),
    ).first()
    print(json.dumps({
        "rows": n, "copies": a.copies, "hot_meter_rows": skew.filter("meterid = -1").count(),
        "hot_key_rows": hot_rows, "seconds": results,
        "hot_vs_window": {"rows": check["rows"], "max_rel_diff": check["max_rel_diff"], "null_mismatches": check["null_mismatches"]},
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
