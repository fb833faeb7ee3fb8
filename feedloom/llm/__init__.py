"""Operators for preparing training text: archives, deduplication, screening, packing, scoring."""
