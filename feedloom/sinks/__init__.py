"""Ordered text and encoded payloads."""
