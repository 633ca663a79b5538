"""Sequencing-read analytics on Spark DataFrames."""
