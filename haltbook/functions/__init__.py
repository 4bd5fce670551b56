"""Column expressions: time, text, repair."""
