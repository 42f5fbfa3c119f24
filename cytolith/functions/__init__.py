"""Column functions on DNA strings and numeric kernels."""
