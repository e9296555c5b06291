"""Column helpers shared by all operators."""
