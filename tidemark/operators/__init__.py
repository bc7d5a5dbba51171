"""DataFrame operators: DataFrames and parameters in, a DataFrame out."""
