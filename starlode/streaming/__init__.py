"""Incremental reductions by Structured Streaming."""
