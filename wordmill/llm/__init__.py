"""Operators for large-scale training-data pipelines.

One module per operator; nothing else in the library imports this package. ``queries.py`` holds
the thin registered queries and ``oracle.py`` their SQL statements.
"""
