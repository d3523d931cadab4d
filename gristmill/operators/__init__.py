"""Parsing, ranking, constraints."""
