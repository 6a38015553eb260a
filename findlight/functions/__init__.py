"""Column functions: normalisers, analyzers, vectors and scores."""
