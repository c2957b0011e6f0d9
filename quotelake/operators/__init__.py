"""DataFrame operators: each is a function from DataFrames (and parameters) to a lazily built DataFrame."""
