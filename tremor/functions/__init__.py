"""Scalar functions: geometry, kernels, special functions, hash-keyed random numbers."""
