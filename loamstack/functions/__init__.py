"""Text and similarity functions as Column expressions."""
