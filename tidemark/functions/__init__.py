"""Column functions: version vectors, paths and keyed identifiers."""
