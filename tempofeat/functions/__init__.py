"""Column functions and aggregate registry."""
