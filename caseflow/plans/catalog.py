"""Importing this module registers every query."""

from caseflow.plans import catalog_events, catalog_cases, catalog_input, catalog_prep, catalog_models  # noqa: F401
