"""Version-graph analytics on Spark DataFrames."""
