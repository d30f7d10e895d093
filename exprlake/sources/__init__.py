"""Where releases come from: catalog, matrix, sample and chemistry files."""
