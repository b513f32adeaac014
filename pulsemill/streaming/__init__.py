"""Structured Streaming runners over the same functions as the batch queries."""
