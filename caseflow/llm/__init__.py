"""Operators for preparing large text, web and embedding corpora.

Each module holds one operator with its own general interface; ``queries``
registers the thin digest queries.  Nothing outside this subpackage imports it.
"""
