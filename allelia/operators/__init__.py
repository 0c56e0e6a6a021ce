"""Association operators over canonical DataFrames."""
