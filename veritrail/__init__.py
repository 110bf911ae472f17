"""Decision-provenance analytics on Spark: DataFrames in, DataFrames out."""
