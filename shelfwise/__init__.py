"""Retail analytics and training-data preparation as Spark DataFrame operations."""
