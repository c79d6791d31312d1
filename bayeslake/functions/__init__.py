"""Column expressions (densities, guarded logarithms, z-score)."""
