"""Column functions: dates, numbers, text and arrays."""
