"""Operators for large-scale training-data preparation."""
