"""Readers that turn files into all-text tables."""
