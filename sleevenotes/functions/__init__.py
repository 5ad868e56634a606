"""Column expressions and list aggregates."""
