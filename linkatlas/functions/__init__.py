"""Column expressions and small result formats."""
