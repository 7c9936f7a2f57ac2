"""Document extraction and feedback analytics on Spark DataFrames."""
