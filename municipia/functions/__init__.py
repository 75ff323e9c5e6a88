"""Column functions on decree texts."""
