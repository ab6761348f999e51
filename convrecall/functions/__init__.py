"""Text functions as Column expressions."""
