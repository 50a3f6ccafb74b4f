"""Column expressions, and the plain Python that Arrow batches run."""
