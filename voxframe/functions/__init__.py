"""Column-level functions (no jobs, no shuffles)."""
