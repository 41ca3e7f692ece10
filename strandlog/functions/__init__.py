"""Column expressions for ids, times and values."""
