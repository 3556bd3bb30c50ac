"""A corpus-analytics engine on Spark DataFrames."""
