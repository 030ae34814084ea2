"""Structured Streaming twins of batch bars."""
