"""Relational operators of snapshot comparison."""
