"""Incremental query-log archive (Structured Streaming)."""
