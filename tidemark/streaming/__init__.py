"""Structured Streaming over commit events."""
