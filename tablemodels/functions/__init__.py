"""Column expressions: cleaning and dense-vector arithmetic."""
