"""A psychophysiology analytics engine on Spark DataFrames."""
