"""Column roles of an event log.

Operators never hard-code column names: they receive a :class:`LogCols`
naming the case, activity, timestamp, sequence, status and optional columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class LogCols:
    case: str = "case_id"
    activity: str = "activity"
    timestamp: str = "timestamp"
    seq: str | None = "seq"
    status: str = "status"
    resource: str | None = "resource"
    cost: str | None = "cost"
    deadline: str | None = "deadline"
    group_code: str | None = "group_code"
    priority: str | None = "priority"
    purpose_code: str | None = "purpose_code"
    intervention_type: str | None = "intervention_type"
    # extra keys that make the event order total when time and seq tie
    tiebreak: tuple[str, ...] = field(default_factory=tuple)

    def order_columns(self) -> list[str]:
        cols = [self.timestamp]
        if self.seq:
            cols.append(self.seq)
        cols.extend(self.tiebreak)
        return cols

    def with_(self, **kw) -> "LogCols":
        return replace(self, **kw)


CANONICAL = LogCols()
