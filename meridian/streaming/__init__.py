"""Structured Streaming forms of the survival operators."""
