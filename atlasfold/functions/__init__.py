"""Column expressions: geometry, scalars and residuals."""
