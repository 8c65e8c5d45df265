"""Operators for large-scale training-data preparation; nothing outside this subpackage imports it."""
