"""Column functions: text, vectors, JSON and previews."""
