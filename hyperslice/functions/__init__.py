"""Column expressions: scalar functions, colours, curves, covariances and column codecs."""
