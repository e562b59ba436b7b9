"""Column functions on text, paths, code and vectors."""
