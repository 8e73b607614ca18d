"""Text clustering and cluster labelling on Spark DataFrames."""
