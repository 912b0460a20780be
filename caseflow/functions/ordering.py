"""Total event order inside a case.

pandas sorts missing keys last; Spark ascending puts them first, so every key
is ``asc_nulls_last``.  For ``min_by``/``max_by`` the order is packed into a
struct whose first field is ``key IS NULL`` so that a missing time sorts last
(struct comparison would otherwise put nulls first).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseflow.functions.roles import LogCols


def order_keys(cols: LogCols) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols.order_columns()]


def null_first_struct(names: list[str]) -> Column:
    parts = []
    for i, c in enumerate(names):
        parts.append(F.col(c).isNull().alias(f"n{i}"))
        parts.append(F.col(c).alias(f"v{i}"))
    return F.struct(*parts)


def order_struct(cols: LogCols) -> Column:
    """Struct that compares like the event order (nulls last on every key)."""
    return null_first_struct(cols.order_columns())
