"""Evidence retrieval and corpus operations on Spark DataFrames."""
