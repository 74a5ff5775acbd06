"""Operators #26–89: filters, joins, aggregations, windows, set operations,
feature encoding, growth fits, loss weights, models and metrics."""
