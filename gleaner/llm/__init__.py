"""Operators for training-data pipelines on text. Nothing outside this package imports it."""
