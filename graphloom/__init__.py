"""Graph and build-history analytics over Spark DataFrames."""
