"""Row and column operators: every function takes DataFrames and returns a DataFrame."""
