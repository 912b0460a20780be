"""DuckDB SQL for the oracle side of every registered query.

The fixture logs (FIXTURES.md §3) are rebuilt from the driver tables as CTEs
so that each oracle statement is self-contained.
"""

from __future__ import annotations

_EVENT_ATTRS = """
    event_type AS activity, ts AS "timestamp", event_id AS seq, event_type AS status,
    json_extract_string(props, '$.k') AS resource, value AS cost, {deadline} AS deadline,
    CAST(user_id % 7 AS VARCHAR) AS group_code,
    CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS priority,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS purpose_code,
    CAST(event_id % 3 AS VARCHAR) AS intervention_type"""

LOG_SQL = {
    "log_day": "SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS case_id,"
               + _EVENT_ATTRS.format(deadline="CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 18 HOUR")
               + " FROM events",
    "log_session": """SELECT case_id,""" + _EVENT_ATTRS.format(
        deadline="min(ts) OVER (PARTITION BY case_id) + INTERVAL 24 HOUR") + """ FROM (
        SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS VARCHAR) AS case_id
        FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                              OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000
                         THEN 1 ELSE 0 END AS brk FROM events) s0) s1""",
    "log_user": "SELECT CAST(user_id AS VARCHAR) AS case_id,"
                + _EVENT_ATTRS.format(deadline="min(ts) OVER (PARTITION BY user_id) + INTERVAL 29 DAY")
                + " FROM events",
    "log_order": """SELECT l_orderkey AS case_id, l_returnflag || '-' || l_linestatus AS activity,
        l_shipdate AS "timestamp", l_linenumber AS seq, l_returnflag || '-' || l_linestatus AS status,
        CAST(l_suppkey AS VARCHAR) AS resource, l_extendedprice AS cost,
        o_orderdate + INTERVAL 365 DAY AS deadline, CAST(l_partkey % 7 AS VARCHAR) AS group_code,
        o_orderpriority AS priority, o_orderstatus AS purpose_code, l_returnflag AS intervention_type,
        l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS quantity, l_discount AS discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}

ORDER_SQL = {
    "log_day": '"timestamp" ASC NULLS LAST, seq ASC NULLS LAST',
    "log_session": '"timestamp" ASC NULLS LAST, seq ASC NULLS LAST',
    "log_user": '"timestamp" ASC NULLS LAST, seq ASC NULLS LAST',
    "log_order": '"timestamp" ASC NULLS LAST, seq ASC NULLS LAST, partkey ASC NULLS LAST, '
                 'suppkey ASC NULLS LAST, cost ASC NULLS LAST',
}

DAY = "86400000000.0"
HOUR = "3600000000.0"


def enriched_sql(log: str = "log_day", prefix: bool = False) -> str:
    """CTEs ``log`` and ``enr`` (transition, next_us, lead_us, time_to_next, lead_time[, trace])."""
    order = ORDER_SQL[log]
    pre = ""
    if prefix:
        pre = f""",
        CASE WHEN case_id IS NOT NULL THEN list(status) FILTER (WHERE status IS NOT NULL) OVER (PARTITION BY case_id
             ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE [status] END AS trace_list"""
    body = f"""log AS ({LOG_SQL[log]}),
    enr0 AS (SELECT *,
        CASE WHEN case_id IS NOT NULL THEN status || ' -> ' || lead(status) OVER w END AS transition,
        CASE WHEN case_id IS NULL THEN NULL WHEN lead(1) OVER w IS NULL THEN 0
             ELSE epoch_us(lead("timestamp") OVER w) - epoch_us("timestamp") END AS next_us,
        CASE WHEN case_id IS NOT NULL THEN epoch_us(max("timestamp") OVER (PARTITION BY case_id))
             - epoch_us(min("timestamp") OVER (PARTITION BY case_id)) END AS lead_us{pre}
        FROM log WINDOW w AS (PARTITION BY case_id ORDER BY {order})),
    enr AS (SELECT *, next_us / {DAY} AS time_to_next, lead_us / {DAY} AS lead_time
        {", array_to_string(trace_list, ' -> ') AS trace" if prefix else ""} FROM enr0)"""
    return body


def case_traces_sql(log: str = "log_day", value: str = "status", sep: str = " -> ",
                    src: str = "log") -> str:
    """Select of one row per case: ``case_id, trace, lead_us`` (nulls skipped)."""
    order = ORDER_SQL[log]
    return f"""SELECT case_id,
        array_to_string(list({value} ORDER BY {order}) FILTER (WHERE {value} IS NOT NULL), '{sep}') AS trace,
        epoch_us(max("timestamp")) - epoch_us(min("timestamp")) AS lead_us
        FROM {src} WHERE case_id IS NOT NULL GROUP BY case_id"""
