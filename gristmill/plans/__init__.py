"""Queries over the test tables: known columns are made messy, parsed, and must come back."""
