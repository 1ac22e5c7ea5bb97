"""Operators for large training corpora: scoring, formatting, deduplication, search, encoding, packing."""
