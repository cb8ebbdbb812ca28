"""symloom: code structure as a graph, queried with Spark DataFrames."""
