"""wayspan: per-entity movement analytics as plain Spark DataFrame functions."""
