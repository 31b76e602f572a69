"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; ``queries``
registers the thin query of each operator and its SQL.
"""
