"""Column functions: text, numbers, geometry, colour."""
