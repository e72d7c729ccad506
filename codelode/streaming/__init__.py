"""Structured Streaming maintenance of the index."""
