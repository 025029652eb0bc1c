"""Column functions used inside the operators."""
