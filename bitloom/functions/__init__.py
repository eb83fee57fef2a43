"""Column functions over bit vectors and records."""
