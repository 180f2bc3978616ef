"""Column functions: mutation strings and protein sequences."""
