"""Operators over the stored tables."""
