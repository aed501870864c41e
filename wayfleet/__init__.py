"""Fleet telemetry analytics on Spark DataFrames."""
