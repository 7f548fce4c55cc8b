"""Structured Streaming versions of the log and manifest operators."""
