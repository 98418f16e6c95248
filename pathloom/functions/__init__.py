"""Scalar functions as Column expressions, and their numpy twins for Arrow kernels."""
