"""tempora: interval alignment, timed-text and corpus analytics on Spark DataFrames."""
