"""caseflow — process event-log analytics and root-cause modelling on Spark.

Every operator takes and returns Spark DataFrames; column roles are passed
as arguments (see :class:`caseflow.functions.roles.LogCols`).
"""

from caseflow.functions.roles import LogCols, CANONICAL

__all__ = ["LogCols", "CANONICAL"]
