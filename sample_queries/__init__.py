"""Queries over the sample tables, and the same results in plain SQL."""
