"""Decisions made on schema-sized metadata before a plan is built."""
