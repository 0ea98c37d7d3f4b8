"""A memory-corpus engine on Spark: DataFrames in, DataFrames out."""
