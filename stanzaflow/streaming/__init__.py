"""Structured Streaming forms (extensions)."""
