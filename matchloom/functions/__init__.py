"""Column functions: text keys, similarities, vectors, plane geometry, display formats."""
