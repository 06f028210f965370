"""Scalar functions, as plain Python for the kernels and as columns for queries."""
