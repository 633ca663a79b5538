"""Training-data operators: ten corpus stages built on Spark DataFrames."""
