"""Operators for preparing training text: search, scoring, filtering, deduplication and packing."""
