"""Contract-event analytics on Spark DataFrames and Structured Streaming."""
