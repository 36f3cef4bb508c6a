"""Column expressions, and the pure Python functions that the extraction needs."""
