"""Operators over clip-level tables."""
