"""Column expressions, SQL functions and NumPy tile kernels."""
