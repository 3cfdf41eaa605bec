"""Column functions: every one is an expression over built-in Spark functions."""
