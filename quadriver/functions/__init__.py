"""Column functions on values."""
