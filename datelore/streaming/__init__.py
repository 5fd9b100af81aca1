"""Structured Streaming forms of the ingest and state operators."""
