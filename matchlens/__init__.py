"""Match-telemetry analytics on Spark DataFrames."""
