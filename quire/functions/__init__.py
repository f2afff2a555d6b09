"""Scalar functions as Column expressions, with plain Python twins where a value is computed on the driver."""
