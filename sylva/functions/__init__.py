"""Column functions on paths, sizes and times."""
