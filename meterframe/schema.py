"""Column roles of the billing table and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's data model for identical results)
# ---------------------------------------------------------------------------
# Residence code -> display category used by the dashboard composition chart.
RES_MAP: Mapping[str, str] = {"N-Resid [0]": "Commercial", "Resid [1]": "Residential"}
# Metric column -> display label, in registry order.
METRICS: Mapping[str, str] = {"kwh": "kWh", "paymoney": "Pay", "ghc": "GHC"}
# Columns never offered as facets / never taken from a request as a selection.
EXCLUDE_COLS = frozenset(
    {"chargedate", "chargedate_str", "month", "month_str", "year", "kwh", "ghc", "paymoney", "res"}
)
# Date text format of the raw CSV exports (day-abbreviated month-two digit year).
RAW_DATE_FORMATS = ("d-MMM-yy",)
# Bucket frequencies accepted from a request; anything else means daily.
FREQS = ("D", "W", "M")
# Caps of the facet lists.
FACET_CAP = 200
METER_OPTIONS_CAP = 500
SEARCH_LIMIT = 200
# Composition chart: number of named slices before the remainder slice.
TOP_N_SLICES = 8
OTHER_LABEL = "Other"
UNKNOWN_LABEL = "Unknown"
# Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# Residence display labels of the weekday/weekend profile (config direction).
RES_DISPLAY = {"N-Resid [0]": "Non-Residential", "Resid [1]": "Residential"}


@dataclass(frozen=True)
class Roles:
    """Names of the columns each operator needs; one object replaces globals."""

    date: str = "chargedate"
    meter: str = "meterid"
    key: str = "key"  # unique row key: the tie-break of every ordered window
    location: str = "loc"
    residence: str = "res"
    residence_mapped: str = "res_mapped"
    metrics: Mapping[str, str] = field(default_factory=lambda: dict(METRICS))
    exclude: frozenset = field(default_factory=lambda: EXCLUDE_COLS | {"key"})
    res_map: Mapping[str, str] = field(default_factory=lambda: dict(RES_MAP))

    @property
    def metric_names(self) -> list[str]:
        return list(self.metrics)

    def present_metrics(self, columns) -> list[str]:
        cols = set(columns)
        return [m for m in self.metrics if m in cols]


DEFAULT_ROLES = Roles()
