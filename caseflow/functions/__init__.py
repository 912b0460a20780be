"""Column-level building blocks (pure ``pyspark.sql.functions`` expressions)."""

from caseflow.functions.roles import LogCols, CANONICAL
from caseflow.functions.timecols import micros_between, micros_to_days, micros_to_hours, HOUR_US, DAY_US
from caseflow.functions.ordering import order_keys, order_struct, null_first_struct

__all__ = [
    "LogCols", "CANONICAL", "micros_between", "micros_to_days", "micros_to_hours",
    "HOUR_US", "DAY_US", "order_keys", "order_struct", "null_first_struct",
]
