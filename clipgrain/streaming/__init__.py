"""Streaming forms of the clip operators."""
