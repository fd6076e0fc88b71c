"""Operators for preparing training data: dedup, tokens, filters, packing."""
