"""A versioned key-value log and its read views, built on Spark DataFrames."""
