"""Operators over records."""
