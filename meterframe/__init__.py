"""meterframe: meter-billing analytics as plain Spark DataFrame functions.

Every operator takes a DataFrame (plus small Python parameters) and returns a
lazy DataFrame built from Spark's own expressions.  Nothing is collected
unless an operator documents a bounded driver-side step (e.g. per-group
quantile bounds, category dictionaries).
"""

from meterframe.schema import Roles, DEFAULT_ROLES

__all__ = ["Roles", "DEFAULT_ROLES"]
__version__ = "0.1.0"
