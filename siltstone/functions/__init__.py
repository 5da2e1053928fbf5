"""Column functions on text and vectors, and the fixed values they use."""
