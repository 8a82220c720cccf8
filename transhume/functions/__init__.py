"""Column expressions, all built from native Spark functions."""
