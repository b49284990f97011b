"""Operators for training-data pipelines: one module each, `queries.py` applies them to the given tables."""
