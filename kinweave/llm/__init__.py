"""Operators for training-data pipelines: deduplication, search, tokenising, scoring, mixing.

Nothing outside this package imports it. Every operator works on DataFrames and keeps per-row work
in Arrow batches; ``queries.py`` holds the thin registered queries.
"""
