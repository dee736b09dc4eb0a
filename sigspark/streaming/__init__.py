"""Structured Streaming over a static index."""
