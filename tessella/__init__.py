"""Document validation and reconciliation analytics on Spark DataFrames."""
