"""Windowed aggregation of event streams (an extension)."""
