"""Campaign-activity analytics on Spark DataFrames."""
