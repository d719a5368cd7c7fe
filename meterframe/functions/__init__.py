"""Column-level helpers (dates, scalars) and distributed exact quantiles."""
