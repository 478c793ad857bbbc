"""Column expressions: geometry, shape, lines, diversity, binning and normalisation."""
