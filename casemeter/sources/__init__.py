"""Snapshot, log and report readers and writers."""
