"""Structured Streaming queries built on the batch operators."""
