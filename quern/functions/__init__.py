"""Column functions: text, vectors, geography."""
