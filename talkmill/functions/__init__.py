"""Column expressions of the record semantics."""
