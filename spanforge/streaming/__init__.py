"""Structured Streaming over interval rows: a fitted model's predictions on a stream."""
