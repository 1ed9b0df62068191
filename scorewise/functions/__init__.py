"""Column expressions: ids, arrays, frame arithmetic and text."""
