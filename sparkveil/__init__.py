"""Text-privacy and audit analytics on Spark DataFrames."""
