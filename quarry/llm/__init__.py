"""Operators for training-data pipelines: the thirteen of the README's second list.

Nothing outside this package imports it. Every operator takes and returns DataFrames; `queries.py` holds
the thin contract queries and their SQL.
"""
