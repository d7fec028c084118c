"""Readers, writers and role views of the tables."""
