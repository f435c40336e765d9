"""Graph-ranking, history and text analytics on Spark DataFrames."""
