"""Continuous ingestion into an index."""
