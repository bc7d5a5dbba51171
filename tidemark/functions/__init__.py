"""Column-level helpers; every one is a native expression."""
