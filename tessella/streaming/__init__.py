"""Incremental and Structured Streaming jobs."""
