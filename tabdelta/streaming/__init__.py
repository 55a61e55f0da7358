"""Continuous comparison of arriving snapshots; an extension beyond batch use."""
