"""Structured Streaming forms of the metrics."""
