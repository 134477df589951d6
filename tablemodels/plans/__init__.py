"""End-to-end preparations built from the operators."""
