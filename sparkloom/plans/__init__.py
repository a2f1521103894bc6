"""Queries over the standard tables, and the SQL that says the same."""
