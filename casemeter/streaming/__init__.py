"""Structured Streaming monitors over an append-only attempt log."""
