"""Structured Streaming over live bars and ticks."""
