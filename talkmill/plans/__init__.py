"""Declarative queries, compiled to column expressions."""
