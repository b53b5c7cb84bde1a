"""screenlens: screenshot understanding and text processing on Spark DataFrames."""
