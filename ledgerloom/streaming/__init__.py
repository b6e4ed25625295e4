"""Structured Streaming versions of the ingest operators."""
