"""Structured Streaming versions of the scorers."""
