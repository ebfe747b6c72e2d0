"""Operators for training-data pipelines; each ``opN`` module holds one operator and its registered query."""
