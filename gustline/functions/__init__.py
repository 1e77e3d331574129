"""Column functions; all are built-in expressions, so they stay inside code generation."""
