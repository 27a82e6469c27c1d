"""Operators for large training-data pipelines; see ``queries`` for the registered forms."""
