"""timeweave: point-in-time (as-of) joins on the Spark DataFrame API."""

from timeweave.operators.asof import asof_join
from timeweave.operators.result import asof_summary, asof_value

__all__ = ["asof_join", "asof_summary", "asof_value"]
