"""Dashboard payloads: the operators' results in the JSON shapes a dashboard reads.

Each function runs the Spark operators and collects only their small, bounded
result (buckets, <= 9 slices, locations, capped facet lists, one summary row)
into plain Python lists and dicts -- arrays only at the edge.
"""

from __future__ import annotations

from typing import Dict, List, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.operators import aggregates as agg
from meterframe.operators import facets as fc
from meterframe.operators.filters import FilterParams, metric_label, params_from_request, validate_metrics
from meterframe.schema import DEFAULT_ROLES, FACET_CAP, METER_OPTIONS_CAP, SEARCH_LIMIT, Roles


def chart_data(df: DataFrame, request: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Line chart: labels plus one value list per valid metric (null mean -> 0.0)."""
    p = params_from_request(request, df.columns, roles)
    metrics = validate_metrics(df, p.metric, roles, multi=True)
    if not metrics:
        return {"labels": [], "values": [], "metric_label": p.metric or "", "date_col": roles.date}
    out = agg.bucketed_mean(df, p, roles, metrics).collect()
    return {
        "labels": [r["label"] for r in out],
        "values": {m: [float(r[m]) for r in out] for m in metrics},
        "metric_labels": {m: metric_label(m, roles) for m in metrics},
        "date_col": roles.date,
    }


def _slices(df: DataFrame, rows_df: DataFrame, p: FilterParams, segment: str, roles: Roles) -> Dict:
    out = rows_df.collect()
    metric = (validate_metrics(df, p.metric, roles, multi=False) or [None])[0]
    return {
        "labels": [r["label"] for r in out],
        "values": [float(r["value"]) for r in out],
        "metric_label": metric_label(metric, roles) if metric else (p.metric or ""),
        "segment": segment,
    }


def pie_data(df: DataFrame, request: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Composition: top 8 slices of one metric plus 'Other'."""
    p = params_from_request(request, df.columns, roles)
    seg = roles.residence_mapped if roles.residence_mapped in df.columns else (
        roles.location if roles.location in df.columns else "")
    return _slices(df, agg.composition(df, p, roles).orderBy("position"), p, seg, roles)


def bar_data(df: DataFrame, request: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Totals per location, descending."""
    p = params_from_request(request, df.columns, roles)
    return _slices(df, agg.totals_by_location(df, p, roles), p, roles.location, roles)


def filter_options(df: DataFrame, payload: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Facet lists under the full filter, cut at the dashboard's lengths (``truncated`` names those that
    were), the filtered date span and row count."""
    p = params_from_request(payload, df.columns, roles, enforce_exclusions=False, check_freq=False)
    facets = payload.get("facets") or None
    caps = {c: METER_OPTIONS_CAP if c == roles.meter else FACET_CAP for c in df.columns}
    lists: Dict[str, List[str]] = {}
    truncated = set()
    for r in fc.facet_values(df, p, facets, caps, roles).orderBy("facet", "position").collect():
        lists.setdefault(r["facet"], []).append(r["value"])
        if r["total"] > caps[r["facet"]]:
            truncated.add(r["facet"])
    span = agg.date_bounds(df, p, roles).first()
    return {
        "options": lists,
        "truncated": sorted(truncated),
        "dates": {"min": span["date_min"], "max": span["date_max"]},
        "rows": agg.row_count(df, p, roles).first()["rows"],
    }


def meter_options(df: DataFrame, payload: Mapping, roles: Roles = DEFAULT_ROLES) -> List[str]:
    """Meter ids for the search box (regex search, own selection ignored)."""
    p = params_from_request(payload, df.columns, roles, enforce_exclusions=False, check_freq=False)
    try:
        limit = int(payload.get("limit") or SEARCH_LIMIT)
    except (TypeError, ValueError):
        limit = SEARCH_LIMIT
    q = str(payload.get("q") or "").strip()
    return [r["value"] for r in fc.meter_options(df, p, q, limit, roles=roles).collect()]


def stats(df: DataFrame, request: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Stats panel: per metric label, sum, mean, median, min, max."""
    p = params_from_request(request, df.columns, roles)
    return {
        r["metric"]: {k: (r[k] if k == "label" else float(r[k])) for k in ("label", "sum", "mean", "median", "min", "max")}
        for r in agg.metric_stats(p.apply(df, roles), roles).collect()
    }


def summary(df: DataFrame, request: Mapping, roles: Roles = DEFAULT_ROLES) -> Dict:
    """Summary panel: rows, cols, meters, locations, date span."""
    p = params_from_request(request, df.columns, roles)
    r = agg.dataset_summary(p.apply(df, roles), roles).first()
    return {k: r[k] for k in ("rows", "cols", "meters", "locations", "date_min", "date_max")}


def health(df: DataFrame) -> Dict:
    r = agg.health(df).first()
    return {"status": "ok", "rows": r["rows"], "cols": r["cols"]}
