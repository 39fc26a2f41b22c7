"""Key-value analytics on DataFrames."""
