"""Operators: each fit is an aggregation returning small params; each
transform is a projection."""
