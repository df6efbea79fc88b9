"""Structured Streaming twins of operators with state."""
