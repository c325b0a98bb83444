"""Column functions on statement text."""
