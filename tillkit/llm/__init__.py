"""Operators of a training-data pipeline: dedup, tokens, search, mixing, labels.

Nothing outside this subpackage imports it. ``queries.PLANS`` holds the
registered queries and ``queries.SQL`` their DuckDB equivalents.
"""
