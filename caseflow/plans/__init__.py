"""Composite plans and the registry of named queries."""
