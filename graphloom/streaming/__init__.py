"""Incremental upkeep on Structured Streaming."""
