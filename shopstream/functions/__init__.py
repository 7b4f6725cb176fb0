"""Column-level scalar functions (built-in expressions only, no Python UDFs)."""
