"""Prepare tabular datasets with Spark: clean, order, split, type, lay out, and prompt."""
