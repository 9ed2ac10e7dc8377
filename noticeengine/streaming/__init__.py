"""Structured Streaming forms of the store's daily steps."""
