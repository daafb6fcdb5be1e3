"""Column functions: no row is moved, everything stays in generated code."""
