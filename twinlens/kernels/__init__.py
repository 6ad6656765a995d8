"""NumPy kernels; nothing here imports Spark."""
