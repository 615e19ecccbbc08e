"""Evidence, timeline and training-corpus analytics on Spark DataFrames."""
