"""Scalar functions: Columns where Spark has the built-ins, Arrow-backed functions where it has not."""
