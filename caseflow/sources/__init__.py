"""Readers, writers and the fixture logs built from the driver tables."""

from caseflow.sources.fixtures import load_log, log_day, log_session, log_user, log_order, SLA_HOURS

__all__ = ["load_log", "log_day", "log_session", "log_user", "log_order", "SLA_HOURS"]
