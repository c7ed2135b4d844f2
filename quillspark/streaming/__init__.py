"""Incremental state with Structured Streaming."""
