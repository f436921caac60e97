"""Operators of a training-data pipeline, and the queries that apply them.

Nothing else in the package imports from here.
"""
