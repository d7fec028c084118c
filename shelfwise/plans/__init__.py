"""Queries over the tables, and end-to-end plans."""
