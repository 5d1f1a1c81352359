"""Column builders and small vectorised kernels."""
