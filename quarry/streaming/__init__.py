"""Incremental indexing with Structured Streaming."""
