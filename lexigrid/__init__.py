"""Text-corpus analytics on Spark DataFrames."""
