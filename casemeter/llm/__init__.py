"""Operators of a training-data pipeline on documents, pages and benchmarks. Nothing else in the library imports this."""
