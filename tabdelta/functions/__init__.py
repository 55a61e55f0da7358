"""Column expressions and name functions."""
