"""Column helpers and the few pandas functions Spark has no builtin for."""
