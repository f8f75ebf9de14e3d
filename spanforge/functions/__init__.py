"""Column expressions and small DataFrame helpers for text and intervals."""
