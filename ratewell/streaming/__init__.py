"""Structured Streaming jobs over the result log."""
