"""driftline: change-stream, replica and corpus analytics on Spark DataFrames."""
