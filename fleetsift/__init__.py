"""Fleet-wide incident-response analytics on Spark DataFrames."""
