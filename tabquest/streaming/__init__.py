"""Structured Streaming forms of the metrics and audit jobs."""
