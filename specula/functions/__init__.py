"""Column-level statistics."""
